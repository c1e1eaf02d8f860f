"""Independent DuckDB SQL oracle for the registered queries.

Each entry is plain ANSI SQL over the driver's test tables (region nation
customer supplier part orders lineitem ...).  The SQL re-derives everything
from the raw tables; it shares no code with the Spark implementation.
Shared CTEs are composed as text.
"""

from __future__ import annotations

AS_OF_MONTH_START = "DATE '2001-08-01'"  # first of the as-of month of the test data
WINDOW_START = "DATE '2000-08-01'"       # twelve months earlier

DIVISION = """CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'AU' WHEN 'BUILDING' THEN 'CO'
  WHEN 'FURNITURE' THEN 'WO' WHEN 'HOUSEHOLD' THEN 'EL' WHEN 'MACHINERY' THEN 'ME'
  ELSE c.c_mktsegment END"""

AREA = """CASE {d} WHEN 'AU' THEN 'Auto' WHEN 'WO' THEN 'Wood' WHEN 'ME' THEN 'Metal'
  WHEN 'CO' THEN 'Construction' WHEN 'CA' THEN 'Cargo' WHEN 'CP' THEN 'ConstrSite project'
  WHEN 'EL' THEN 'House Engineering' WHEN 'MA' THEN 'Engineering workshop (Betriebswerkstatt)'
  ELSE {d} END"""

SIZE_BAND = "CASE WHEN p.p_size <= 10 THEN 'S' WHEN p.p_size <= 25 THEN 'M' ELSE 'L' END"

# Active customers (status 4 = positive balance) with region code and label.
CUST = f"""
cust AS (
  SELECT DISTINCT customer, sales_region, customerdivision,
    CASE WHEN sales_region BETWEEN '000000000011' AND '000000000018'
         THEN 'Region-' || CAST(CAST(sales_region AS INTEGER) AS VARCHAR)
         ELSE sales_region END AS region
  FROM (
    SELECT CAST(c.c_custkey AS VARCHAR) AS customer,
           lpad(CAST(n.n_regionkey + 11 AS VARCHAR), 12, '0') AS sales_region,
           {DIVISION} AS customerdivision
    FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
    WHERE c.c_acctbal > 0
  ) x
  WHERE sales_region BETWEEN '000000000011' AND '000000000018' AND trim(customer) <> ''
)"""

INVOICE = CUST + f""",
invoice AS (
  SELECT DISTINCT
    CAST(o.o_orderdate AS DATE) AS calendar_day,
    CAST(o.o_custkey AS VARCHAR) AS customernumber,
    CAST(o.o_orderdate AS DATE) AS order_date,
    o.o_orderpriority AS order_reason,
    CAST(l.l_orderkey AS VARCHAR) AS sales_receipt,
    cu.customerdivision,
    l.l_returnflag AS customerindustry,
    CAST(l.l_suppkey AS VARCHAR) AS custcontact,
    o.o_orderstatus AS cchierl1,
    l.l_linestatus AS cchierl2,
    strftime(l.l_shipdate, '%Y-%m-%d') AS cchierl3,
    o.o_totalprice AS custturnover,
    l.l_extendedprice * (1 - l.l_discount) AS sales_value,
    l.l_quantity AS soldnumber,
    'ALL' AS product_field,
    p.p_type AS product_group,
    p.p_type || '/' || p.p_brand AS product_class,
    p.p_type || '/' || p.p_brand || '/' || {SIZE_BAND} AS product_family,
    CAST(p.p_partkey AS VARCHAR) AS model_number,
    CAST(l.l_partkey AS VARCHAR) AS product_number,
    cu.sales_region, cu.region, p.p_name AS product_name,
    year(o.o_orderdate) AS sales_year, month(o.o_orderdate) AS sales_month,
    {AREA.format(d='cu.customerdivision')} AS customer_area
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN cust cu ON CAST(o.o_custkey AS VARCHAR) = cu.customer
  JOIN part p ON CAST(p.p_partkey AS VARCHAR) = CAST(l.l_partkey AS VARCHAR)
  WHERE l.l_extendedprice * (1 - l.l_discount) >= 0 AND p.p_size NOT IN (49, 50)
)"""

WINDOWED = INVOICE + f""",
win AS (
  SELECT * FROM invoice WHERE calendar_day BETWEEN {WINDOW_START} AND {AS_OF_MONTH_START}
)"""


def ratings_cte(src: str = "win", item: str = "model_number", name: str = "ratings",
                cap: float = 10.0) -> str:
    """D3 re-derived: quantity per (area, customer, item), share of the item
    total within the area, capped, min-max scaled to [0, 10] per area."""
    return f""",
{name}_q AS (
  SELECT customer_area, customernumber, {item} AS item, SUM(soldnumber) AS product_orders
  FROM {src} WHERE {item} IS NOT NULL
  GROUP BY customer_area, customernumber, {item}
  HAVING SUM(soldnumber) > 0
),
{name}_t AS (
  SELECT customer_area, item, SUM(product_orders) AS avg_order
  FROM {name}_q GROUP BY customer_area, item HAVING SUM(product_orders) <> 0
),
{name}_r AS (
  SELECT q.customer_area, q.customernumber, q.item, q.product_orders, t.avg_order,
         q.product_orders / t.avg_order AS raw_rating,
         CASE WHEN q.product_orders / t.avg_order > {cap} THEN {cap}
              ELSE q.product_orders / t.avg_order END AS rating
  FROM {name}_q q JOIN {name}_t t ON q.customer_area = t.customer_area AND q.item = t.item
),
{name}_b AS (
  SELECT customer_area, MIN(rating) AS emin, MAX(rating) AS emax FROM {name}_r GROUP BY customer_area
),
{name} AS (
  SELECT r.*, round(CASE WHEN b.emax = b.emin THEN 5.0
                         ELSE (r.rating - b.emin) / (b.emax - b.emin) * 10.0 END, 5) AS interaction
  FROM {name}_r r JOIN {name}_b b ON r.customer_area = b.customer_area
)"""


def top_cte(src: str = "ratings", k: int = 10, name: str = "top") -> str:
    return f""",
{name} AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY customer_area, customernumber
                                 ORDER BY interaction DESC, item ASC) AS rn
    FROM {src}) z
  WHERE rn <= {k}
)"""


def _with(body: str) -> str:
    return "WITH " + body.lstrip()


SQL: dict[str, str] = {}

SQL["build_invoices"] = _with(INVOICE) + """
SELECT * REPLACE (strftime(calendar_day, '%Y-%m-%d') AS calendar_day,
                  strftime(order_date, '%Y-%m-%d') AS order_date,
                  round(sales_value, 6) AS sales_value)
FROM invoice"""

SQL["customer_ratings"] = _with(WINDOWED + ratings_cte()) + """
SELECT customer_area, customernumber, item AS model_number, product_orders, avg_order,
       round(raw_rating, 6) AS raw_rating, round(rating, 6) AS rating, interaction
FROM ratings"""

SQL["top10_per_customer"] = _with(WINDOWED + ratings_cte() + top_cte()) + """
SELECT customer_area, customernumber, item AS model_number, CAST(rn AS INTEGER) AS "row",
       interaction
FROM top"""


# ------------------------------------------------------------------ rules
def keycols(keys: list[str], alias: str = "") -> str:
    p = f"{alias}." if alias else ""
    return "".join(f"{p}{k}, " for k in keys)


def keyjoin(keys: list[str], a: str, b: str) -> str:
    return " AND ".join([f"{a}.{k} = {b}.{k}" for k in keys] or ["TRUE"])


def baskets_cte(src: str, item_expr: str, keys: list[str], name: str = "bask",
                extra_where: str = "TRUE") -> str:
    k = keycols(keys)
    return f""",
{name} AS MATERIALIZED (
  SELECT {k}customernumber, sales_receipt, list_sort(list(DISTINCT item)) AS items
  FROM (SELECT {k}customernumber, sales_receipt, {item_expr} AS item FROM {src}
        WHERE {item_expr} IS NOT NULL AND {extra_where}) z
  GROUP BY {k}customernumber, sales_receipt
)"""


SEP = "chr(31)"


def itemsets_cte(bask: str, keys: list[str], min_support: float, name: str = "sets") -> str:
    """Exact frequent itemsets: every subset of every basket, counted.  ``skey`` is
    the itemset as text, by which rules are joined."""
    k = keycols(keys)
    return f""",
{name}_n AS MATERIALIZED (SELECT {k}COUNT(*) AS n_baskets FROM {bask} GROUP BY ALL),
{name}_sub AS (
  SELECT {k}list_filter(items, lambda x, i: ((m >> (i - 1)) & 1) = 1) AS items
  FROM (SELECT {k}items, unnest(range(1, (1 << len(items)))) AS m FROM {bask}) z
),
{name}_c AS (SELECT {k}array_to_string(items, {SEP}) AS skey, ANY_VALUE(items) AS items, COUNT(*) AS freq
  FROM {name}_sub GROUP BY {k}skey),
{name} AS MATERIALIZED (
  SELECT {keycols(keys, 'c')}c.items, c.skey, c.freq
  FROM {name}_c c JOIN {name}_n n ON {keyjoin(keys, 'n', 'c')}
  WHERE c.freq >= ceil(CAST({min_support} AS DOUBLE) * n.n_baskets)
)"""


def rules_cte(sets: str, keys: list[str], min_conf: float, min_lift: float | None,
              max_freq: int | None, name: str = "rules") -> str:
    k = keycols(keys)
    cap = f"WHERE freq <= {max_freq}" if max_freq is not None else ""
    lift = f"AND lift >= {min_lift}" if min_lift is not None else ""
    return f""",
{name}_s AS (SELECT {k}skey AS c, freq AS freq_c FROM {sets} WHERE len(items) = 1),
{name}_cap AS (SELECT * FROM {sets} {cap}),
{name}_u AS (SELECT {k}items, freq, unnest(items) AS c FROM {name}_cap WHERE len(items) >= 2),
{name}_b AS MATERIALIZED (SELECT {k}freq, c, list_filter(items, lambda x: x <> c) AS antecedent,
  array_to_string(list_filter(items, lambda x: x <> c), {SEP}) AS akey FROM {name}_u),
{name}_all AS (
  SELECT {keycols(keys, 'b')}b.antecedent, [b.c] AS consequent,
         CAST(b.freq AS DOUBLE) / a.freq AS confidence,
         (CAST(b.freq AS DOUBLE) / a.freq) / (CAST(s.freq_c AS DOUBLE) / n.n_baskets) AS lift,
         CAST(b.freq AS DOUBLE) / n.n_baskets AS support
  FROM {name}_b b
  JOIN {name}_cap a ON {keyjoin(keys, 'a', 'b')} AND a.skey = b.akey
  JOIN {name}_s s ON {keyjoin(keys, 's', 'b')} AND s.c = b.c
  JOIN {sets}_n n ON {keyjoin(keys, 'n', 'b')}
),
{name} AS MATERIALIZED (SELECT * FROM {name}_all WHERE confidence >= {min_conf} {lift})"""


NAME_ITEM = "split_part(product_name, ':', 1)"
POOLED = INVOICE + baskets_cte("invoice", NAME_ITEM, []) + itemsets_cte("bask", [], 0.001)

SQL["baskets"] = _with(INVOICE + baskets_cte("invoice", NAME_ITEM, ["customer_area"])) + """
SELECT customer_area, customernumber, sales_receipt, array_to_string(items, ',') AS items,
       CAST(len(items) AS INTEGER) AS "count"
FROM bask"""

SQL["frequent_itemsets"] = _with(POOLED) + """
SELECT array_to_string(items, ',') AS items, CAST(len(items) AS INTEGER) AS size, freq
FROM sets"""

_RULE_OUT = """SELECT {k}array_to_string(antecedent, ',') AS antecedent,
       array_to_string(consequent, ',') AS consequent, round(confidence, 6) AS confidence,
       round(lift, 6) AS lift, round(support, 6) AS support
FROM rules"""

SQL["association_rules"] = _with(POOLED + rules_cte("sets", [], 0.05, 1.0, None)) + \
    _RULE_OUT.format(k="")
SQL["capped_rules"] = _with(POOLED + rules_cte("sets", [], 0.05, 1.0, 900)) + \
    _RULE_OUT.format(k="")
SQL["lift_floor"] = _with(POOLED + rules_cte("sets", [], 0.05, None, None)) + """
SELECT array_to_string(antecedent, ',') AS antecedent, array_to_string(consequent, ',') AS consequent,
       round(lift, 6) AS lift FROM rules WHERE lift >= 1.0"""
SQL["freq_cap"] = _with(POOLED) + """
SELECT array_to_string(items, ',') AS items, freq FROM sets WHERE freq <= 900"""

# Names as items over the whole history, per-area rules at the fixed support.
def flag_base(confidence: float) -> str:
    return (INVOICE + ratings_cte("invoice", NAME_ITEM, "fr") + top_cte("fr", 10, "ftop")
            + baskets_cte("invoice", NAME_ITEM, ["customer_area"])
            + itemsets_cte("bask", ["customer_area"], 0.001)
            + rules_cte("sets", ["customer_area"], confidence, 1.0, None))


FLAG_BASE = flag_base(0.5)

SQL["all_area_rules"] = _with(FLAG_BASE) + _RULE_OUT.format(k="customer_area, ")

MATCHING = """,
na AS (SELECT customer_area, customernumber, COUNT(*) AS n_a FROM ftop GROUP BY ALL),
ante AS (SELECT DISTINCT customer_area, antecedent, len(antecedent) AS n_b FROM rules),
ante_items AS (SELECT customer_area, antecedent, n_b, unnest(antecedent) AS item FROM ante),
cand AS (
  SELECT t.customer_area, t.customernumber, a.antecedent, a.n_b, COUNT(*) AS n_ab
  FROM ftop t JOIN ante_items a ON t.customer_area = a.customer_area AND t.item = a.item
  GROUP BY ALL
),
jac AS (
  SELECT c.*, na.n_a, CAST(c.n_ab AS DOUBLE) / (na.n_a + c.n_b - c.n_ab) AS jaccard
  FROM cand c JOIN na ON c.customer_area = na.customer_area AND c.customernumber = na.customernumber
),
best_ante AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY customer_area, antecedent
      ORDER BY confidence DESC, lift DESC, array_to_string(consequent, ',')) AS r
    FROM rules) z WHERE r = 1
),
best AS (
  SELECT * FROM (
    SELECT j.customer_area, j.customernumber, j.antecedent, j.jaccard, j.n_ab, j.n_b,
           b.consequent, b.confidence, b.lift,
           row_number() OVER (PARTITION BY j.customer_area, j.customernumber
             ORDER BY j.jaccard DESC, b.confidence DESC, b.lift DESC,
                      array_to_string(j.antecedent, ','), array_to_string(b.consequent, ',')) AS r
    FROM jac j JOIN best_ante b ON j.customer_area = b.customer_area AND j.antecedent = b.antecedent
    WHERE j.jaccard > 0) z WHERE r = 1
),
actual AS (
  SELECT customer_area, customernumber, string_agg(item, ',' ORDER BY rn) AS actual_products,
         list(item ORDER BY rn) AS actual_list
  FROM ftop GROUP BY ALL
)"""

MATCH = FLAG_BASE + MATCHING

SQL["jaccard_join"] = _with(MATCH) + """
SELECT customer_area, customernumber, array_to_string(antecedent, ',') AS antecedent,
       n_ab, CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS INTEGER) AS n_b, round(jaccard, 6) AS jaccard
FROM jac"""

SQL["best_rule"] = _with(MATCH) + """
SELECT customer_area, customernumber, array_to_string(antecedent, ',') AS antecedent,
       array_to_string(consequent, ',') AS consequent, round(jaccard, 6) AS jaccard,
       round(confidence, 6) AS confidence, round(lift, 6) AS lift
FROM best"""

SQL["bundle_by_rule"] = _with(MATCH) + """
SELECT a.customer_area, a.customernumber, a.actual_products,
       array_to_string(b.antecedent, ',') AS highest_similarity,
       array_to_string(b.consequent, ',') AS consequent, round(b.confidence, 6) AS confidence,
       round(b.lift, 6) AS lift, round(b.jaccard, 6) AS jaccard,
       array_to_string(list_concat(b.antecedent, b.consequent), ',') AS rules
FROM actual a JOIN best b ON a.customer_area = b.customer_area AND a.customernumber = b.customernumber"""

SQL["match_split"] = _with(flag_base(0.7) + MATCHING) + """
SELECT a.customer_area, a.customernumber, (b.customernumber IS NOT NULL) AS matched
FROM actual a LEFT JOIN best b
  ON a.customer_area = b.customer_area AND a.customernumber = b.customernumber"""


# ------------------------------------------------------------------ similarity
# Second configuration: part keys as items over the whole history.
NAMED = """named AS (
  SELECT j.*, ps.product_name AS similar_product_name, pa.product_name AS actual_product_name
  FROM nbj j JOIN plist ps ON ps.model_number = j.other JOIN plist pa ON pa.model_number = j.item
)"""
UNNAMED = """named AS (
  SELECT *, other AS similar_product_name, item AS actual_product_name FROM nbj)"""


def sim_base(base: str, src: str, item: str, support: float, confidence: float,
             names: bool = True) -> str:
    """Rules, cosine neighbours and fallback bundles of one run."""
    return (base + ratings_cte(src, item, "sr") + top_cte("sr", 10, "stop")
            + baskets_cte(src, item, ["customer_area"], "sbask")
            + itemsets_cte("sbask", ["customer_area"], support, "ssets")
            + rules_cte("ssets", ["customer_area"], confidence, 1.0, None, "srules") + """,
bought AS (SELECT customer_area, customernumber, item FROM sr WHERE interaction > 0),
n_items AS (SELECT customer_area, item, COUNT(*) AS n FROM bought GROUP BY ALL),
co AS (
  SELECT x.customer_area, x.item AS a, y.item AS b, COUNT(*) AS co
  FROM bought x JOIN bought y ON x.customer_area = y.customer_area
   AND x.customernumber = y.customernumber AND x.item < y.item
  GROUP BY ALL
),
sim AS (
  SELECT co.customer_area, co.a, co.b, co.co,
         co.co / sqrt(CAST(na.n * nb.n AS DOUBLE)) AS sim
  FROM co JOIN n_items na ON co.customer_area = na.customer_area AND co.a = na.item
          JOIN n_items nb ON co.customer_area = nb.customer_area AND co.b = nb.item
),
sims AS (
  SELECT customer_area, a AS item, b AS other, co, sim FROM sim
  UNION ALL SELECT customer_area, b AS item, a AS other, co, sim FROM sim
),
top2 AS (
  SELECT *, round(sim, 3) AS sim_score FROM (
    SELECT *, row_number() OVER (PARTITION BY customer_area, item ORDER BY sim DESC, other) AS rank
    FROM sims) z WHERE rank <= 2
),
s_na AS (SELECT customer_area, customernumber, COUNT(*) AS n_a FROM stop GROUP BY ALL),
s_ante AS (SELECT DISTINCT customer_area, antecedent, len(antecedent) AS n_b FROM srules),
s_cand AS (
  SELECT t.customer_area, t.customernumber, a.antecedent, COUNT(*) AS n_ab, a.n_b
  FROM stop t JOIN (SELECT customer_area, antecedent, n_b, unnest(antecedent) AS item FROM s_ante) a
    ON t.customer_area = a.customer_area AND t.item = a.item
  GROUP BY ALL
),
s_best_ante AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_area, antecedent
      ORDER BY confidence DESC, lift DESC, array_to_string(consequent, ',')) AS r FROM srules) z
  WHERE r = 1
),
s_best AS (
  SELECT * FROM (
    SELECT c.customer_area, c.customernumber, c.antecedent, b.consequent, b.confidence, b.lift,
      CAST(c.n_ab AS DOUBLE) / (na.n_a + c.n_b - c.n_ab) AS jaccard,
      row_number() OVER (PARTITION BY c.customer_area, c.customernumber
        ORDER BY CAST(c.n_ab AS DOUBLE) / (na.n_a + c.n_b - c.n_ab) DESC, b.confidence DESC,
                 b.lift DESC, array_to_string(c.antecedent, ','),
                 array_to_string(b.consequent, ',')) AS r
    FROM s_cand c JOIN s_na na ON c.customer_area = na.customer_area
                              AND c.customernumber = na.customernumber
    JOIN s_best_ante b ON c.customer_area = b.customer_area AND c.antecedent = b.antecedent) z
  WHERE r = 1
),
s_actual AS (
  SELECT customer_area, customernumber, list(item ORDER BY rn) AS actual_list
  FROM stop GROUP BY ALL
),
unmatched AS (
  SELECT a.* FROM s_actual a WHERE NOT EXISTS (
    SELECT 1 FROM s_best b WHERE b.customer_area = a.customer_area
                             AND b.customernumber = a.customernumber)
),
heads AS (
  SELECT customer_area, customernumber, unnest(actual_list[1:2]) AS item FROM unmatched
),
nbj AS (
  SELECT h.customer_area, h.customernumber, h.item, t.other, t.rank, t.sim_score
  FROM heads h JOIN top2 t ON h.customer_area = t.customer_area AND h.item = t.item
),
plist AS (SELECT DISTINCT model_number, split_part(product_name, ':', 1) AS product_name
          FROM invoice),
""" + (NAMED if names else UNNAMED) + """,
grp AS (
  SELECT customer_area, customernumber, item,
         list(other ORDER BY rank, other) AS sims_list,
         list(sim_score ORDER BY rank, other) AS score_list,
         list_sort(list(DISTINCT actual_product_name)) AS actual_names,
         list_sort(list(DISTINCT similar_product_name)) AS similar_names
  FROM named GROUP BY ALL
),
fallback AS (
  SELECT customer_area, customernumber, [item] AS actual_products, sims_list AS most_similar_items,
         score_list AS sim_score,
         list_filter(list_concat([item], sims_list),
                     lambda x, i: list_position(list_concat([item], sims_list), x) = i) AS recommend,
         list_filter(list_concat(actual_names, similar_names),
                     lambda x, i: list_position(list_concat(actual_names, similar_names), x) = i)
           AS recommend_name
  FROM grp
)""")


SIM_BASE = sim_base(INVOICE, "invoice", "model_number", 0.001, 0.5)
# A run in which some customers have rules and others fall back on neighbours.
MIXED_BASE = sim_base(INVOICE, "invoice", NAME_ITEM, 0.001, 0.7, names=False)

SQL["cooccurrence_join"] = _with(SIM_BASE) + "\nSELECT customer_area, a, b, co FROM co"
SQL["item_cosine"] = _with(SIM_BASE) + """
SELECT customer_area, item, other, co, round(sim, 6) AS sim FROM sims"""
SQL["top2_similar"] = _with(SIM_BASE) + """
SELECT customer_area, item, other, CAST(rank AS INTEGER) AS rank, sim_score FROM top2"""
SQL["first_n_items"] = _with(SIM_BASE) + """
SELECT customer_area, customernumber, array_to_string(actual_list[1:2], ',') AS head_items
FROM unmatched"""
SQL["neighbour_join"] = _with(SIM_BASE) + """
SELECT customer_area, customernumber, item, other, CAST(rank AS INTEGER) AS rank, sim_score
FROM nbj"""
SQL["name_lookup"] = _with(SIM_BASE) + """
SELECT customer_area, customernumber, item, other, actual_product_name, similar_product_name
FROM named"""
SQL["set_string_agg"] = _with(SIM_BASE) + """
SELECT customer_area, customernumber, item, array_to_string(sims_list, ',') AS most_similar_items,
       array_to_string(score_list, ',') AS sim_score
FROM grp"""
_FALLBACK_OUT = """
SELECT customer_area, customernumber, array_to_string(actual_products, ',') AS actual_products,
       array_to_string(most_similar_items, ',') AS most_similar_items,
       array_to_string(sim_score, ',') AS sim_score, array_to_string(recommend, ',') AS recommend,
       array_to_string(recommend_name, ',') AS recommend_name,
       CAST(len(recommend) AS INTEGER) AS rules_count
FROM fallback"""
SQL["item_fallback"] = _with(SIM_BASE) + _FALLBACK_OUT
SQL["score_left_join"] = _with(SIM_BASE) + """,
strong AS (SELECT customer_area, customernumber, item, list(sim_score ORDER BY rank, other) AS score_list
  FROM nbj WHERE sim_score >= 0.5 GROUP BY ALL)
SELECT g.customer_area, g.customernumber, g.item, array_to_string(g.sims_list, ',') AS most_similar_items,
       array_to_string(coalesce(s.score_list, []), ',') AS sim_score
FROM grp g LEFT JOIN strong s ON g.customer_area = s.customer_area
  AND g.customernumber = s.customernumber AND g.item = s.item"""
SQL["bundle_pipeline"] = _with(MIXED_BASE) + """
SELECT customer_area, customernumber, array_to_string(actual_products, ',') AS actual_products,
       array_to_string(most_similar_items, ',') AS most_similar_items,
       array_to_string(recommend, ',') AS recommend, array_to_string(sim_score, ',') AS sim_score,
       'similarity' AS method
FROM fallback
UNION ALL
SELECT customer_area, customernumber, array_to_string(antecedent, ',') AS actual_products,
       array_to_string(consequent, ',') AS most_similar_items,
       array_to_string(list_concat(antecedent, consequent), ',') AS recommend,
       CAST(round(confidence, 6) AS VARCHAR) AS sim_score, 'rule' AS method
FROM s_best"""


# ------------------------------------------------------------------ smaller operators
def sround(expr: str, n: int) -> str:
    """HALF_UP rounding of the shortest decimal text of a double (Spark's rule)."""
    return f"CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38, 24)), {n}) AS DOUBLE)"


def snap(expr: str, n: int) -> str:
    """Half-up rounding of a sum or mean of amounts whose noise beyond eight places
    is cut off."""
    return f"CAST(round(CAST({expr} AS DECIMAL(28, 8)), {n}) AS DOUBLE)"


CA_LIST = "customer_area, customernumber"

SQL["scan_parquet"] = "SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice FROM lineitem"
SQL["semantic_scan"] = """SELECT c_custkey AS customer, c_name AS custcontact,
  c_mktsegment AS customerindustry, c_acctbal AS balance FROM customer"""
SQL["company_scan"] = "SELECT * FROM customer WHERE c_nationkey = 7"
SQL["csv_scan"] = "SELECT p_partkey, p_name, p_retailprice FROM part"
SQL["parquet_sink"] = SQL["customer_ratings"].replace(WINDOWED.lstrip() + ratings_cte(), INVOICE.lstrip() + ratings_cte("invoice"))
SQL["area_sink"] = SQL["top10_per_customer"].replace(WINDOWED.lstrip() + ratings_cte(), INVOICE.lstrip() + ratings_cte("invoice"))
SQL["area_result_read"] = f"SELECT * FROM ({SQL['area_sink']}) z WHERE customer_area = 'Metal'"

ORDERS_M = """WITH m AS (SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y%m') AS calendar_yearmonth
  FROM orders)"""
SQL["latest_month"] = ORDERS_M + """
SELECT * FROM m WHERE calendar_yearmonth = (SELECT max(calendar_yearmonth) FROM m WHERE o_orderstatus = 'O')"""
SQL["global_max"] = ORDERS_M + """
SELECT max(calendar_yearmonth) AS last_month FROM m WHERE o_orderstatus = 'O'"""
SQL["active_customers"] = _with(CUST) + """
SELECT customer, sales_region, customerdivision AS sales_sector_of_customer, region FROM cust"""
SQL["code_range"] = """SELECT CAST(c.c_custkey AS VARCHAR) AS customer,
  lpad(CAST(n.n_regionkey + 11 AS VARCHAR), 12, '0') AS sales_region
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE lpad(CAST(n.n_regionkey + 11 AS VARCHAR), 12, '0') BETWEEN '000000000012' AND '000000000014'"""
SQL["not_blank"] = """SELECT * FROM (SELECT p_partkey, CASE WHEN p_size > 45 THEN ' ' ELSE p_type END AS label
  FROM part) z WHERE trim(label) <> ''"""
SQL["active_products"] = f"""SELECT CAST(p_partkey AS VARCHAR) AS s_p_product_number,
  p_type || '/' || p_brand || '/' || {SIZE_BAND} AS n_product_family_nr, p_name AS product_name
FROM part p WHERE p.p_size NOT IN (49, 50)"""
BIG_ORDERS = "(SELECT * FROM orders WHERE o_totalprice > 250000)"
SQL["drop_null_keys"] = f"""SELECT c.c_custkey, o.o_orderkey FROM customer c JOIN {BIG_ORDERS} o ON c.c_custkey = o.o_custkey"""
SQL["not_null"] = SQL["drop_null_keys"]
SQL["dropna_any"] = f"""SELECT c.c_custkey, o.o_orderkey, strftime(o.o_orderdate, '%Y-%m-%d') AS o_orderdate
FROM customer c JOIN {BIG_ORDERS} o ON c.c_custkey = o.o_custkey"""
SQL["drop_negative"] = """SELECT l_orderkey, l_linenumber, round(l_extendedprice - 50000, 6) AS margin
FROM lineitem WHERE l_extendedprice - 50000 >= 0"""
_LINES = "SELECT customernumber, sales_receipt, model_number, strftime(calendar_day, '%Y-%m-%d') AS calendar_day"
SQL["trailing_12m"] = _with(WINDOWED) + f"\n{_LINES} FROM win"
SQL["fixed_range"] = _with(INVOICE) + f"""
{_LINES} FROM invoice WHERE calendar_day BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'"""
SQL["area_filter"] = _with(INVOICE) + f"\n{_LINES} FROM invoice WHERE customer_area = 'Metal'"
SQL["family_exclude"] = _with(INVOICE) + """
SELECT customer_area, customernumber, sales_receipt, model_number, product_family FROM invoice
WHERE NOT coalesce(customer_area = 'Metal' AND (product_family IS NULL
  OR product_family IN ('LARGE/Brand#4/L', 'STANDARD/Brand#16/L')), FALSE)"""
SQL["positive_only"] = _with(INVOICE) + """
SELECT customer_area, customernumber, model_number, SUM(soldnumber) AS product_orders
FROM invoice GROUP BY ALL HAVING SUM(soldnumber) > 0"""
LOYAL = INVOICE + """,
loyal AS (SELECT customernumber FROM invoice GROUP BY customernumber
  HAVING COUNT(DISTINCT CAST(sales_year AS VARCHAR) || '-' || CAST(sales_month AS VARCHAR)) > 5),
diverse AS (SELECT customernumber FROM invoice WHERE customernumber IN (SELECT customernumber FROM loyal)
  GROUP BY customernumber HAVING COUNT(DISTINCT model_number) > 5)"""
SQL["loyal_customers"] = _with(LOYAL) + "\nSELECT customernumber FROM loyal"
SQL["diverse_customers"] = _with(LOYAL) + "\nSELECT customernumber FROM diverse"
SQL["rowcount_guard"] = """SELECT CAST(COUNT(*) AS BIGINT) AS before_rows,
  CAST(SUM(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) AS BIGINT) AS after_rows,
  SUM(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) < COUNT(*) AS reduced FROM customer"""

SQL["region_label"] = """SELECT customer, sales_region,
  CASE WHEN sales_region BETWEEN '000000000011' AND '000000000018'
       THEN 'Region-' || CAST(CAST(sales_region AS INTEGER) AS VARCHAR) ELSE sales_region END AS region
FROM (SELECT CAST(c.c_custkey AS VARCHAR) AS customer,
  lpad(CAST(n.n_regionkey + 11 AS VARCHAR), 12, '0') AS sales_region
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey) z"""
SQL["area_label"] = f"""SELECT customer, customerdivision, {AREA.format(d='customerdivision')} AS customer_area
FROM (SELECT CAST(c.c_custkey AS VARCHAR) AS customer, {DIVISION} AS customerdivision
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey) z"""
SQL["positional_rename"] = """SELECT l_orderkey AS sales_receipt, l_partkey AS product_number,
  l_quantity AS soldnumber FROM lineitem"""
SQL["rename_columns"] = f"""SELECT CAST(p_partkey AS VARCHAR) AS article_number, 'ALL' AS product_field,
  p_type AS product_group, p_type || '/' || p_brand AS product_class,
  p_type || '/' || p_brand || '/' || {SIZE_BAND} AS product_family,
  CAST(p_partkey AS VARCHAR) AS productmodel FROM part p"""
SQL["drop_columns"] = f"""SELECT CAST(p_partkey AS VARCHAR) AS s_p_product_number,
  p_type AS n_product_group_nr, p_type || '/' || p_brand AS n_product_class_nr,
  p_type || '/' || p_brand || '/' || {SIZE_BAND} AS n_product_family_nr,
  CAST(p_partkey AS VARCHAR) AS n_product_model_nr FROM part p"""
QTY = INVOICE + """,
qty AS (SELECT customer_area, customernumber, model_number, SUM(soldnumber) AS product_orders
  FROM invoice GROUP BY ALL HAVING SUM(soldnumber) > 0),
turn AS (SELECT customer_area, customernumber, model_number, SUM(sales_value) AS turnover
  FROM invoice GROUP BY ALL),
turnp AS (SELECT * FROM turn WHERE turnover > 0),
turn_mean AS (SELECT * FROM (SELECT customer_area, model_number, AVG(turnover) AS avg_turnover
  FROM turnp GROUP BY ALL) z WHERE avg_turnover <> 0),
mean_r AS (SELECT t.*, m.avg_turnover, t.turnover / m.avg_turnover AS raw_rating
  FROM turnp t JOIN turn_mean m USING (customer_area, model_number))"""
SQL["share_rating"] = _with(QTY) + """
SELECT q.customer_area, q.customernumber, q.model_number,
       round(q.product_orders / t.tot, 6) AS raw_rating
FROM qty q JOIN (SELECT customer_area, model_number, SUM(product_orders) AS tot FROM qty
                 GROUP BY ALL HAVING SUM(product_orders) <> 0) t USING (customer_area, model_number)"""
SQL["mean_rating"] = _with(QTY) + """
SELECT customer_area, customernumber, model_number, """ + snap("turnover", 4) + """ AS turnover, """ + snap("avg_turnover", 6) + """ AS avg_turnover,
       round(raw_rating, 6) AS raw_rating FROM mean_r"""
SQL["cap_outlier"] = _with(QTY) + """
SELECT customer_area, customernumber, model_number,
       round(CASE WHEN raw_rating > 2.0 THEN 2.0 ELSE raw_rating END, 6) AS rating FROM mean_r"""
SQL["binary_interaction"] = _with(INVOICE + ratings_cte("invoice")) + """
SELECT customer_area, customernumber, item AS model_number,
       CASE WHEN interaction > 0 THEN 1 ELSE 0 END AS interacted FROM ratings"""
SQL["cast_keys"] = _with(INVOICE) + """
SELECT TRY_CAST(customernumber AS BIGINT) AS customernumber, TRY_CAST(model_number AS BIGINT) AS model_number,
       TRY_CAST(cchierl3 AS BIGINT) AS cchierl3
FROM (SELECT DISTINCT customernumber, model_number, cchierl3 FROM invoice) z"""

SQL["name_prefix"] = """SELECT p_partkey, split_part(p_name || ':' || p_brand, ':', 1) AS with_sep,
  split_part(p_type, ':', 1) AS without_sep FROM part"""
SQL["trim_text"] = "SELECT p_partkey, trim('  ' || p_name || ' ') AS name FROM part"
SQL["like_match"] = "SELECT p_partkey, p_type, p_name FROM part WHERE p_type LIKE 'S%' AND p_name NOT LIKE '%ring%'"
SQL["concat_month"] = _with(INVOICE) + """
SELECT DISTINCT customernumber, CAST(sales_year AS VARCHAR) || '-' || CAST(sales_month AS VARCHAR) AS month_year
FROM invoice"""
POOLED_RULES = POOLED + rules_cte("sets", [], 0.05, 1.0, None)
SQL["rule_string"] = _with(POOLED_RULES) + """
SELECT array_to_string(antecedent, ',') AS antecedent, array_to_string(consequent, ',') AS consequent,
  array_to_string(antecedent, ',') || ',' || array_to_string(consequent, ',') AS rules FROM rules"""
SQL["list_text"] = _with(MATCH) + """
SELECT customer_area, customernumber, array_to_string(actual_list, ', ') AS actual_products FROM actual"""
SQL["truncate_label"] = """SELECT p_partkey, CASE WHEN length(p_name) > 10 THEN substr(p_name, 1, 10) || '...'
  ELSE p_name END AS label FROM part"""
SQL["strip_brackets"] = _with(MATCH) + """
SELECT customer_area, customernumber, actual_products FROM actual"""
SQL["split_text"] = _with(MATCH) + """
SELECT customer_area, customernumber, CAST(len(actual_list) AS INTEGER) AS n,
       array_to_string(actual_list, '|') AS joined FROM actual"""
SQL["year_month"] = _with(INVOICE) + """
SELECT DISTINCT sales_receipt, year(calendar_day) AS y, month(calendar_day) AS m FROM invoice"""
SQL["month_start"] = """SELECT o_orderkey,
  strftime(CAST(date_trunc('month', o_orderdate) AS DATE) - INTERVAL 1 YEAR, '%Y-%m-%d') AS year_back,
  strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_first FROM orders"""
SQL["round_n"] = _with(INVOICE + ratings_cte("invoice")) + f"""
SELECT customer_area, customernumber, item AS model_number, {sround('raw_rating', 3)} AS r3,
  {sround('raw_rating', 5)} AS r5, {sround('raw_rating', 6)} AS r6 FROM ratings"""
SQL["array_set_sorted"] = _with(INVOICE) + """
SELECT sales_receipt, array_to_string(list_sort(list(DISTINCT product_name)), ',') AS s,
  CAST(COUNT(DISTINCT product_name) AS INTEGER) AS n FROM invoice GROUP BY sales_receipt"""
SQL["array_concat"] = _with(POOLED_RULES) + """
SELECT array_to_string(antecedent, ',') AS antecedent, array_to_string(consequent, ',') AS consequent,
  array_to_string(list_concat(antecedent, consequent), ',') AS joined FROM rules"""
SQL["array_unique"] = _with(MATCH) + """
SELECT a.customer_area, a.customernumber,
  array_to_string(list_filter(list_concat(a.actual_list, b.consequent),
    lambda x, i: list_position(list_concat(a.actual_list, b.consequent), x) = i), ',') AS items
FROM actual a JOIN best b ON a.customer_area = b.customer_area AND a.customernumber = b.customernumber"""
SQL["array_length"] = _with(MATCH) + """
SELECT customer_area, customernumber, CAST(len(actual_list) AS INTEGER) AS n FROM actual"""
SQL["array_get"] = _with(POOLED_RULES) + """
SELECT array_to_string(antecedent, ',') AS antecedent, consequent[1] AS consequent_item FROM rules"""
SQL["array_slice"] = _with(MATCH) + """
SELECT customer_area, customernumber, array_to_string(actual_list[1:2], ',') AS head FROM actual"""
SQL["array_explode"] = _with(POOLED_RULES) + """
SELECT array_to_string(antecedent, ',') AS antecedent, array_to_string(consequent, ',') AS consequent,
  unnest(antecedent) AS antecedent_split FROM rules"""
SQL["set_overlap"] = _with(MATCH) + """
SELECT customer_area, customernumber, round(jaccard, 6) AS jaccard FROM best"""

SQL["orders_per_item"] = _with(INVOICE) + """
SELECT customernumber, model_number, SUM(soldnumber) AS product_orders FROM invoice GROUP BY ALL"""
SQL["turnover_per_item"] = _with(INVOICE) + f"""
SELECT customernumber, model_number, {snap("SUM(sales_value)", 4)} AS turnover FROM invoice
GROUP BY customernumber, model_number"""
SQL["item_total"] = _with(INVOICE) + """
SELECT model_number, SUM(product_orders) AS avg_order FROM (
  SELECT customernumber, model_number, SUM(soldnumber) AS product_orders FROM invoice GROUP BY ALL) z
GROUP BY model_number"""
SQL["item_mean"] = _with(INVOICE) + f"""
SELECT model_number, {snap("AVG(turnover)", 6)} AS avg_turnover FROM (
  SELECT customernumber, model_number, SUM(sales_value) AS turnover FROM invoice
  GROUP BY ALL) z GROUP BY model_number"""
SQL["active_months"] = _with(INVOICE) + """
SELECT customernumber, COUNT(DISTINCT CAST(sales_year AS VARCHAR) || '-' || CAST(sales_month AS VARCHAR))
  AS active_months FROM invoice GROUP BY customernumber"""
SQL["distinct_items"] = _with(INVOICE) + """
SELECT customernumber, COUNT(DISTINCT model_number) AS distinct_items FROM invoice GROUP BY customernumber"""
SQL["customer_item_set"] = _with(MATCH) + """
SELECT customernumber, array_to_string(list_sort(list(DISTINCT item)), ',') AS actual_products
FROM ftop GROUP BY customernumber"""
SQL["interaction_pivot"] = _with(INVOICE + ratings_cte("invoice")) + """
SELECT customernumber, item AS model_number, CASE WHEN SUM(interaction) > 0 THEN 1 ELSE 0 END AS bought
FROM ratings GROUP BY ALL"""
SQL["distinct_rows"] = "SELECT DISTINCT l_orderkey, l_partkey, l_quantity FROM lineitem"
_PLIST = """SELECT DISTINCT model_number, split_part(product_name, ':', 1) AS product_name, product_family,
  product_class, product_group, product_field FROM {src}"""
SQL["distinct_subset"] = _with(INVOICE) + "\n" + _PLIST.format(src="invoice")
SQL["product_list"] = _with(WINDOWED) + "\n" + _PLIST.format(src="win")

SQL["customer_master_join"] = """SELECT CAST(c.c_custkey AS VARCHAR) AS customer,
  lpad(CAST(n.n_regionkey + 11 AS VARCHAR), 12, '0') AS sales_region,
  CASE WHEN c.c_acctbal > 0 THEN 4 ELSE 1 END AS customer_status
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey"""
SQL["invoice_customer_join"] = _with(CUST) + """
SELECT CAST(o.o_custkey AS VARCHAR) AS soldtoparty, CAST(l.l_orderkey AS VARCHAR) AS order_number,
  CAST(l.l_partkey AS VARCHAR) AS product, cu.sales_region, cu.region
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN cust cu ON CAST(o.o_custkey AS VARCHAR) = cu.customer"""
SQL["invoice_product_join"] = f"""
SELECT CAST(l.l_orderkey AS VARCHAR) AS order_number, CAST(l.l_partkey AS VARCHAR) AS product,
  CAST(p.p_partkey AS VARCHAR) AS productmodel,
  p.p_type || '/' || p.p_brand || '/' || {SIZE_BAND} AS product_family
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey
WHERE p.p_size NOT IN (49, 50)"""
SQL["join_back_agg"] = _with(INVOICE) + """
SELECT i.customernumber, i.sales_receipt, i.model_number, round(t.tot, 6) AS customer_total
FROM invoice i JOIN (SELECT customernumber, SUM(sales_value) AS tot FROM invoice GROUP BY ALL) t
  USING (customernumber)"""

ALS_R = INVOICE + """,
als_t AS (SELECT customer_area, customernumber, model_number, SUM(sales_value) AS turnover
  FROM invoice WHERE model_number IS NOT NULL GROUP BY ALL),
als_p AS (SELECT * FROM als_t WHERE turnover > 0),
als_m AS (SELECT * FROM (SELECT customer_area, model_number, AVG(turnover) AS avg_turnover FROM als_p
  GROUP BY ALL) z WHERE avg_turnover <> 0),
als_r AS (SELECT p.*, m.avg_turnover, p.turnover / m.avg_turnover AS raw_rating, 1 AS purchased,
  CASE WHEN p.turnover / m.avg_turnover > 10.0 THEN 10.0 ELSE p.turnover / m.avg_turnover END AS rating
  FROM als_p p JOIN als_m m USING (customer_area, model_number)),
als_s AS (SELECT customer_area, stddev_samp(rating) AS sd, MIN(rating) AS mn, MAX(rating) AS mx
  FROM als_r GROUP BY customer_area),
als_c AS (SELECT customernumber, row_number() OVER (ORDER BY COUNT(*) DESC, customernumber) - 1 AS cid
  FROM als_r GROUP BY customernumber),
als_i AS (SELECT model_number, row_number() OVER (ORDER BY COUNT(*) DESC, model_number) - 1 AS pid
  FROM als_r GROUP BY model_number),
als AS (
  SELECT r.*, CASE WHEN s.sd = 0 THEN 0.0 ELSE r.rating / s.sd END AS std_scaled_rating,
    CASE WHEN s.mx = s.mn THEN 0.5 ELSE (r.rating - s.mn) / (s.mx - s.mn) END AS minmax_scaled_rating,
    CAST(c.cid AS DOUBLE) AS customer_id, CAST(i.pid AS DOUBLE) AS product_id
  FROM als_r r JOIN als_s s USING (customer_area) JOIN als_c c USING (customernumber)
  JOIN als_i i USING (model_number)
)"""
ALS_KEY = "customer_area, customernumber, model_number"
SQL["als_ratings"] = _with(ALS_R) + f"""
SELECT {ALS_KEY}, {snap("turnover", 4)} AS turnover, {snap("avg_turnover", 6)} AS avg_turnover,
  round(raw_rating, 6) AS raw_rating, purchased, round(rating, 6) AS rating,
  round(std_scaled_rating, 6) AS std_scaled_rating, round(minmax_scaled_rating, 6) AS minmax_scaled_rating,
  customer_id, product_id FROM als"""
SQL["minmax_scale"] = _with(ALS_R) + f"""
SELECT {ALS_KEY}, round(minmax_scaled_rating, 6) AS minmax_scaled_rating FROM als"""
SQL["standard_scale"] = _with(ALS_R) + f"""
SELECT {ALS_KEY}, round(std_scaled_rating, 6) AS std_scaled_rating FROM als"""
SQL["string_index"] = _with(ALS_R) + """
SELECT DISTINCT customernumber, customer_id FROM als"""
SQL["assemble_vector"] = _with(ALS_R) + f"""
SELECT {ALS_KEY}, round(rating, 6) AS rating FROM als"""


def bucket(keys: str) -> str:
    """The first six hex digits of the row key's md5, modulo 10000."""
    digits = " + ".join(f"(strpos('0123456789abcdef', substr(h, {i}, 1)) - 1) * {16 ** (6 - i)}"
                        for i in range(1, 7))
    return f"(SELECT *, ({digits}) % 10000 AS bucket FROM (SELECT *, md5('123|' || {keys}) AS h FROM {{src}}) z)"


ROW_KEY = "customernumber || '|' || model_number"
SQL["random_split"] = _with(ALS_R) + f"""
SELECT customernumber, model_number, CASE WHEN bucket < 7000 THEN 'train' ELSE 'test' END AS side
FROM {bucket(ROW_KEY).format(src='als')} s"""

# What a customer bought for most, as ids and back again.
PICKED = ALS_R + """,
picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id
  ORDER BY round(minmax_scaled_rating, 6) DESC, product_id) AS pick FROM als) z WHERE pick <= 3)"""
SQL["id_resolve"] = _with(PICKED) + """
SELECT customer_id, customernumber, product_id, model_number FROM picked"""
SQL["struct_fields"] = _with(PICKED) + """
SELECT customer_id, product_id, round(minmax_scaled_rating, 6) AS rating FROM picked"""


def item_mean_metrics(src: str, label: str, train: int) -> str:
    return f"""
, s AS (SELECT * FROM {bucket(ROW_KEY).format(src=src)} z),
mean AS (SELECT customer_area, model_number, AVG({label}) AS prediction FROM s WHERE bucket < {train}
  GROUP BY ALL),
e AS (SELECT {label} - prediction AS err FROM s JOIN mean USING (customer_area, model_number)
  WHERE bucket >= {train})
SELECT round(AVG(abs(err)), 6) AS mae, round(AVG(err * err), 6) AS mse,
  round(sqrt(AVG(err * err)), 6) AS rmse, COUNT(*) AS n FROM e"""


SQL["rmse_eval"] = _with(ALS_R) + item_mean_metrics("als", "minmax_scaled_rating", 7000)

NCF_R = LOYAL + """,
ncf_q AS (SELECT customer_area, customernumber, model_number, SUM(soldnumber) AS product_orders FROM invoice
  WHERE customernumber IN (SELECT customernumber FROM diverse)
    AND model_number IS NOT NULL GROUP BY ALL HAVING SUM(soldnumber) > 0),
ncf_m AS (SELECT customer_area, model_number, AVG(product_orders) AS avg_order FROM ncf_q GROUP BY ALL
  HAVING AVG(product_orders) <> 0),
ncf_r AS (SELECT q.*, m.avg_order, q.product_orders / m.avg_order AS raw_rating,
  CASE WHEN q.product_orders / m.avg_order > 10.0 THEN 10.0 ELSE q.product_orders / m.avg_order END AS rating
  FROM ncf_q q JOIN ncf_m m USING (customer_area, model_number)),
ncf_b AS (SELECT customer_area, MIN(rating) AS mn, MAX(rating) AS mx FROM ncf_r GROUP BY customer_area),
ncf_w AS (SELECT customer_area, model_number, MIN(rating) AS wmn, MAX(rating) AS wmx FROM ncf_r GROUP BY ALL),
ncf AS (
  SELECT r.*, """ + sround("(r.rating - (w.wmn - 1)) / (w.wmx - (w.wmn - 1))", 3) + """ AS scaled,
    """ + sround("CASE WHEN b.mx = b.mn THEN 0.5 ELSE (r.rating - b.mn) / (b.mx - b.mn) END", 6) + """ AS interaction
  FROM ncf_r r JOIN ncf_b b USING (customer_area) JOIN ncf_w w USING (customer_area, model_number)
)"""
SQL["ncf_ratings"] = _with(NCF_R) + f"""
SELECT {ALS_KEY}, product_orders, round(avg_order, 6) AS avg_order,
  round(raw_rating, 6) AS raw_rating, round(rating, 6) AS rating,
  CASE WHEN scaled > 0 THEN 1 ELSE 0 END AS interaction_round, interaction FROM ncf"""
SQL["item_minmax_window"] = _with(NCF_R) + f"\nSELECT {ALS_KEY}, scaled FROM ncf"
SQL["fit_metrics"] = _with(NCF_R) + item_mean_metrics("ncf", "interaction", 8000)

_DESC = ("'As the product(s) ' || array_to_string({a}, ', ') || ' is purchased often, we are "
         "suggesting these products ' || array_to_string({b}, ', ') || ' which forms the bundle ' "
         "|| array_to_string({c}, ', ')")
SQL["describe_bundle"] = _with(MIXED_BASE) + f"""
SELECT customer_area, customernumber, 'similarity' AS method,
  {_DESC.format(a='actual_products', b='most_similar_items', c='recommend')} AS description
FROM fallback
UNION ALL
SELECT customer_area, customernumber, 'rule' AS method,
  {_DESC.format(a='antecedent', b='consequent', c='list_concat(antecedent, consequent)')} AS description
FROM s_best"""


# ------------------------------------------------------------------ interpretability
EMB_LONG = """WITH el AS (
  SELECT 'label_' || CAST(label AS VARCHAR) AS layer, CAST(vec_id AS VARCHAR) AS "Row",
         CAST(i - 1 AS VARCHAR) AS "Column", round(CAST(v AS DOUBLE), 6) AS "Value"
  FROM (SELECT label, vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i
        FROM embeddings) z
)"""
SQL["factor_matrix_long"] = EMB_LONG + "\nSELECT * FROM el"
SQL["value_range"] = EMB_LONG + """
SELECT layer, MIN("Value") AS min_value, MAX("Value") AS max_value FROM el GROUP BY layer"""
COORD = """WITH pts AS (SELECT vec_id AS "Index", round(CAST(embedding[1] AS DOUBLE), 6) AS tsne1,
  round(CAST(embedding[2] AS DOUBLE), 6) AS tsne2, label AS "Source" FROM embeddings)"""
SQL["point_brush"] = COORD + """
SELECT * FROM pts WHERE tsne1 BETWEEN -0.5 AND 0.5 AND tsne2 BETWEEN -0.5 AND 0.5"""
SQL["source_filter"] = COORD + "\nSELECT * FROM pts WHERE \"Source\" = 1"

EDGES = POOLED_RULES + """,
edges AS (
  SELECT "from", "to", MAX(confidence) AS value FROM (
    SELECT unnest(antecedent) AS "from", consequent[1] AS "to", confidence FROM rules) z
  GROUP BY ALL
),
und AS (SELECT DISTINCT src, dst FROM (
  SELECT "from" AS src, "to" AS dst FROM edges UNION ALL SELECT "to", "from" FROM edges) z),
nodes AS (SELECT src AS id, src AS label, src AS title, COUNT(DISTINCT dst) AS value
  FROM und WHERE src <> dst GROUP BY src),
picked AS (SELECT DISTINCT id FROM (
  SELECT "from" AS id FROM edges WHERE "from" IN ('blue bolt', 'small ring', 'red widget')
  UNION ALL SELECT "to" FROM edges WHERE "from" IN ('blue bolt', 'small ring', 'red widget')) z)"""
SQL["rule_edges"] = _with(EDGES) + '\nSELECT "from", "to", round(value, 6) AS value FROM edges'
SQL["node_degree"] = _with(EDGES) + "\nSELECT id, value FROM nodes"
SQL["rule_nodes"] = _with(EDGES) + "\nSELECT id, label, title, value FROM nodes"
SQL["two_hop"] = _with(EDGES) + """,
l1 AS (SELECT dst AS id FROM und WHERE src = 'blue bolt'),
l2 AS (SELECT u.dst AS id FROM l1 JOIN und u ON u.src = l1.id)
SELECT id, CAST(MIN(level) AS INTEGER) AS level FROM (
  SELECT 'blue bolt' AS id, 0 AS level UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2) z
GROUP BY id"""
SQL["edge_filter"] = _with(EDGES) + "\nSELECT id FROM picked"
SQL["visible_nodes"] = _with(EDGES) + "\nSELECT id, value FROM nodes WHERE id IN (SELECT id FROM picked)"

TREE = INVOICE + """,
plv AS (SELECT DISTINCT product_field, product_group, product_class, product_family, model_number
  FROM invoice),
tree AS (SELECT DISTINCT parent, child, level FROM (
  SELECT product_field AS parent, product_group AS child, 1 AS level FROM plv
  UNION ALL SELECT product_group, product_class, 2 FROM plv
  UNION ALL SELECT product_class, product_family, 3 FROM plv
  UNION ALL SELECT product_family, model_number, 4 FROM plv) z WHERE child IS NOT NULL)"""
SQL["hierarchy_tree"] = _with(TREE) + "\nSELECT parent, child, CAST(level AS INTEGER) AS level FROM tree"
ANC = """SELECT {c}p.model_number AS leaf, unnest([0, 1, 2, 3, 4]) AS level,
  unnest([p.product_field, p.product_group, p.product_class, p.product_family, p.model_number]) AS node
FROM {src} x JOIN plv p ON p.model_number = x.model_number"""
SQL["hierarchy_paths"] = _with(TREE) + "\nSELECT leaf, CAST(level AS INTEGER) AS level, node FROM (" + \
    ANC.format(c="", src="(SELECT DISTINCT model_number FROM plv)") + ") z"

MARKS = SIM_BASE + """,
plv AS (SELECT DISTINCT product_field, product_group, product_class, product_family, model_number
  FROM invoice),
tree AS (SELECT DISTINCT parent, child, level FROM (
  SELECT product_field AS parent, product_group AS child, 1 AS level FROM plv
  UNION ALL SELECT product_group, product_class, 2 FROM plv
  UNION ALL SELECT product_class, product_family, 3 FROM plv
  UNION ALL SELECT product_family, model_number, 4 FROM plv) z WHERE child IS NOT NULL),
act AS (SELECT DISTINCT customernumber, item AS model_number FROM stop),
pred AS (SELECT DISTINCT s.customernumber, t.other AS model_number
  FROM stop s JOIN top2 t ON s.customer_area = t.customer_area AND s.item = t.item),
tagged AS (
  SELECT customernumber, level, node, 1 AS is_a, 0 AS is_p FROM (""" + \
    ANC.format(c="x.customernumber, ", src="act") + """) a
  UNION ALL
  SELECT customernumber, level, node, 0, 1 FROM (""" + \
    ANC.format(c="x.customernumber, ", src="pred") + """) b
),
marks AS (
  SELECT customernumber, level, node,
    CASE WHEN level = 4 AND MAX(is_a) = 1 THEN 'actual' WHEN MAX(is_p) = 1 THEN 'predicted'
         ELSE 'actual' END AS status
  FROM tagged GROUP BY customernumber, level, node
)"""
SQL["actual_vs_predicted"] = _with(MARKS) + """
SELECT customernumber, CAST(level AS INTEGER) AS level, node, status FROM marks"""
SQL["pruned_tree"] = _with(MARKS) + """
SELECT m.customernumber, t.parent, t.child, CAST(t.level AS INTEGER) AS level
FROM tree t JOIN marks m ON t.parent = m.node AND t.level = m.level + 1"""
SQL["marked_links"] = _with(MARKS) + """
SELECT m.customernumber, t.parent, t.child, CAST(t.level AS INTEGER) AS level, m.status
FROM tree t JOIN marks m ON t.child = m.node AND t.level = m.level"""
SQL["area_recommendations"] = _with(MIXED_BASE) + f"""
SELECT customer_area, customernumber,
  {_DESC.format(a='actual_products', b='most_similar_items', c='recommend')} AS description,
  array_to_string(sim_score, ', ') AS sim_score
FROM fallback
UNION ALL
SELECT customer_area, customernumber,
  {_DESC.format(a='antecedent', b='consequent', c='list_concat(antecedent, consequent)')} AS description,
  CAST(confidence AS VARCHAR) AS sim_score
FROM s_best"""


def _spark_rounding(sql: str) -> str:
    """Rewrite every ``round(x, n)`` into Spark's rule: HALF_UP applied to the
    shortest decimal text of the double (DuckDB rounds the binary value)."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k = 1, j + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = sql[j + 6:k - 1]
        expr, _, digits = inner.rpartition(",")
        if inner.startswith("CAST(CAST(") or not digits.strip().isdigit():
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        out.append(sql[i:j])
        out.append(sround(_spark_rounding(expr), int(digits)))
        i = k


SQL["purchased_flag"] = _with(ALS_R) + f"\nSELECT {ALS_KEY}, purchased FROM als"
SQL["basket_window"] = _with(POOLED) + """
SELECT customernumber, sales_receipt, array_to_string(items, ',') AS items,
       CAST(len(items) AS INTEGER) AS "count"
FROM bask"""

SQL = {k: _spark_rounding(v) for k, v in SQL.items()}


SQL["union_bundles"] = SQL["bundle_pipeline"]
