"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM d),
k AS (SELECT *, {_LOWER.format(f"trim(line, {_BLANK})")} AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
f AS (SELECT k.*, r.keeper IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

_ALNUM = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + ", '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

OP3 = f"""
WITH b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT item_id, least(len(w), 10) AS n, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS key FROM bw),
d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
dw AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
hits AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN windows ON windows.n = dw.n AND windows.key = array_to_string(dw.w[dw.i:dw.i + dw.n - 1], ' ')),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS held
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(held, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP4 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.9),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lowest AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
       least(vec_id, coalesce(low, vec_id)) = vec_id AS kept
FROM v LEFT JOIN lowest ON lowest.a = vec_id LEFT JOIN degree ON degree.a = vec_id
"""

OP7 = """
WITH r AS (
  SELECT page_id, page_id // 1000 AS file,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:record:' || page_id || '>'
    || chr(13) || chr(10) || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
    || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))
    || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages)
SELECT file, row_number() OVER o - 1 AS ordinal, page_id,
  CAST(sum(strlen(record)) OVER (o ROWS UNBOUNDED PRECEDING) AS BIGINT) - strlen(record) AS "offset", strlen(record) AS length,
  sha256(record) AS record_sha256,
  CASE page_id % 101 WHEN 0 THEN 'corrupt' WHEN 1 THEN 'corrupt' WHEN 2 THEN 'missing' ELSE 'sound' END AS state
FROM r WINDOW o AS (PARTITION BY file ORDER BY page_id)
"""

OP10 = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS key
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
least_doc AS (SELECT key, min(doc_id) AS low FROM win GROUP BY key),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM win JOIN least_doc USING (key) WHERE low < doc_id),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def _levels(first: str, out: str, paths: str, steps: int) -> str:
    """Common table expressions for ``steps`` hashing steps of the trees in ``first``
    (t, i, h, n) and the paths through them in ``paths`` (r, t, i, cur, proof)."""
    sql = f"{out}0 AS MATERIALIZED (SELECT * FROM {first}), {out}p0 AS MATERIALIZED (SELECT * FROM {paths})"
    for k in range(steps):
        sql += f""",
{out}{k + 1} AS MATERIALIZED (SELECT t, i // 8 AS i, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h,
  (n + 7) // 8 AS n FROM {out}{k} GROUP BY t, i // 8, n),
{out}p{k + 1} AS MATERIALIZED (SELECT r, p.t, p.i // 8 AS i,
  CASE WHEN n = 1 THEN min(cur) ELSE sha256(string_agg(CASE WHEN l.i = p.i THEN cur ELSE h END, '' ORDER BY l.i)) END AS cur,
  min(proof) || coalesce(string_agg(h, '' ORDER BY l.i) FILTER (WHERE l.i <> p.i), '') AS proof
  FROM {out}p{k} p JOIN {out}{k} l ON p.t = l.t AND p.i // 8 = l.i // 8 GROUP BY r, p.t, p.i // 8, n)"""
    return sql


def _leaf(text: str) -> str:
    parts = (f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({' || '.join(parts)})"


_BYTE = "(CASE WHEN b % 8 = 0 THEN xor(c, ascii(substr(CAST(doc_id AS VARCHAR), CAST(b // 8 + 1 AS INTEGER), 1))::BIGINT) ELSE c END)"
#: CRC-32 of the decimal doc_id, bit by bit (polynomial 0xEDB88320).
_CRC32 = ("xor(list_reduce(list_prepend(4294967295::BIGINT, range(0, 8 * strlen(CAST(doc_id AS VARCHAR)))), "
          f"lambda c, b: xor({_BYTE} >> 1, 3988292384 * ({_BYTE} & 1))), 4294967295)")

#: Eight steps hold 8**8 documents of a lang, four 8**4 langs.
OP11 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, lang, {_leaf('text')} AS leaf,
  CASE WHEN {_CRC32} % 3 = 0 THEN {_leaf(_LOWER.format('text'))} ELSE {_leaf('text')} END AS cur FROM documents),
o AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS t, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, leaf) AS r,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),
{_levels("(SELECT t, i, leaf AS h, n FROM o)", "l", "(SELECT r, t, i, cur, '' AS proof FROM o)", 8)},
{_levels("(SELECT 1 AS t, t - 1 AS i, h, count(*) OVER () AS n FROM l8)", "c", "(SELECT r, 1 AS t, t - 1 AS i, cur, proof FROM lp8)", 4)}
SELECT o.doc_id, o.leaf, l8.h AS subroot, c4.h AS root, sha256(proof) AS proof_sha256, cp4.cur AS folded_root, cp4.cur = c4.h AS verified
FROM o JOIN l8 ON o.t = l8.t JOIN cp4 ON cp4.r = o.r CROSS JOIN c4
"""

OP12 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS w FROM documents),
total AS MATERIALIZED (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest({_ALNUM}) AS term FROM benchmark),
t AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY r, term),
f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM t, total GROUP BY term, n_docs),
m AS (SELECT r, doc_id, 100 - 50 + ((50 * len(w) * n_docs) // n_terms) AS m FROM d, total),
s AS (SELECT item_id, r, doc_id, CAST(sum(f.w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM q JOIN t USING (term) JOIN f USING (term) JOIN m USING (r) GROUP BY item_id, r, doc_id),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 50
"""
