"""Ranked lexical search over bit-sliced Bloom signatures.

The index holds blocks of documents of similar size.  A document's signature is a
Bloom filter of its terms, and of (term, level) for every step of ``LEVELS`` that the
term's count reaches; a block stores the signatures by bit: slice j has one bit for
each document row.  The slices of a term's bits, and-ed, are a bitmap of the
documents that may hold it (never missing one that does).

For a block of queries, the weights of a query's terms are summed over those
bitmaps, level by level; times what a level can add to a document's score at most,
they give an upper bound of every document's score.  The documents with the highest
bounds are scored from their texts first; the score that ``top`` of them reach
excludes every document whose bound is below it, and all others are scored from
their texts.  So the result is exact.

Terms are compared by 64-bit hashes; that one of q query terms shares its hash with
one of t other terms has a chance of q * t / 2**64."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwise.llm import bytetext as B
from cartwise.llm.common import batch_bytes, materialize

#: Counts of a term that have signature bits of their own.
LEVELS = (1, 2, 3, 4, 6, 8, 12, 16)
#: Signature bits for each entry, and bits set by it.
BITS, HASHES = 12, 4
#: Bytes of text that are indexed at once, and rows and cells of a block.
ROUND_BYTES, BLOCK_ROWS, BLOCK_CELLS = 16 << 20, 1024, 1 << 24
#: Items and terms of a block of queries.
QUERY_ITEMS, QUERY_TERMS = 512, 1 << 14
#: Times ``top`` documents are scored first; the loosest of them don't set the floor.
FIRST = 3
#: Documents to score that may be broadcast (two longs and a few ints each).
BROADCAST_DOCS = 100_000
INDEX = ("kind int, n_docs long, n_terms long, terms binary, dfs binary, "
         "width int, doc_ids array<long>, keys array<long>, sizes array<long>, slices binary")
BLOCK, STATS = 0, 1


def _positions(h: np.ndarray, level: int, width: int) -> np.ndarray:
    """The bits (by column) of the terms at a level."""
    e = B.mix(h + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2 ** 64))
    low, step = e & np.uint64(0xFFFFFFFF), (e >> np.uint64(32)) | np.uint64(1)
    at = (low[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)
    return (at * np.uint64(width) >> np.uint64(32)).astype(np.int64)


def _counted(texts: B.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term hash, count) of the different terms of each text."""
    texts.words(B.ALNUM, lower=True)
    h = B.lane_hashes(texts)
    order = np.lexsort((h, texts.doc))
    h, doc = h[order], texts.doc[order]
    new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))[:len(h)]
    return doc[new], h[new], np.diff(np.append(new, len(h)))


def _blocks(ids: list, keys: np.ndarray, sizes: np.ndarray, doc: np.ndarray, h: np.ndarray, n: np.ndarray) -> Iterator[dict]:
    """Signature blocks of documents of similar numbers of entries."""
    entries = np.zeros(len(ids), np.int64)
    for least in LEVELS:
        entries += np.bincount(doc[n >= least], minlength=len(ids))
    order = np.argsort(entries, kind="stable")
    first = np.searchsorted(doc, np.arange(len(ids) + 1))
    at = int(np.searchsorted(entries[order], 1))
    while at < len(order):
        least = entries[order[at]]
        to = min(at + BLOCK_ROWS, int(np.searchsorted(entries[order], least * 3 // 2, side="right")))
        while to - at > 8 and (to - at) * BITS * entries[order[to - 1]] > BLOCK_CELLS:
            to = at + (to - at) // 2
        own = order[at:to]
        width = int(BITS * entries[own[-1]])
        bits = np.zeros((width, -(-len(own) // 8) * 8), bool)
        for row, d in enumerate(own):
            held = slice(first[d], first[d + 1])
            for level, floor in enumerate(LEVELS):
                terms = h[held][n[held] >= floor]
                if not len(terms):
                    break
                bits[_positions(terms, level, width).ravel(), row] = True
        yield {"kind": BLOCK, "width": width, "doc_ids": [ids[d] for d in own], "keys": keys[own].tolist(),
               "sizes": sizes[own].tolist(), "slices": np.packbits(bits, axis=1).tobytes()}
        at = to


def _index_round(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
    starts = np.cumsum([0] + [len(p[0]) for p in parts])
    ids = [x for p in parts for x in p[0]]
    keys, sizes, h, n = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 4, 5))
    doc = np.concatenate([p[3] + s for p, s in zip(parts, starts)])
    terms, dfs = np.unique(h, return_counts=True)
    kinds = pa.schema([("kind", pa.int32()), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("terms", pa.binary()), ("dfs", pa.binary()),
                       ("width", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())),
                       ("sizes", pa.list_(pa.int64())), ("slices", pa.binary())])
    stats = {"kind": STATS, "n_docs": int((sizes > 0).sum()), "n_terms": int(sizes.sum()),
             "terms": terms.astype("<u8").tobytes(), "dfs": dfs.astype("<u4").tobytes()}
    yield pa.RecordBatch.from_pylist([stats], schema=kinds)
    for row in _blocks(ids, keys, sizes, doc, h, n):
        yield pa.RecordBatch.from_pylist([row], schema=kinds)


def _index(batches):
    parts, held = [], 0
    for batch in batches:
        for part, texts in B.text_chunks(batch):
            doc, h, n = _counted(texts)
            parts.append((part.column("doc_id").to_pylist(), part.column("key").to_numpy(), np.diff(texts.first), doc, h, n))
            held += len(texts.data)
            if held >= ROUND_BYTES:
                yield from _index_round(parts)
                parts, held = [], 0
    if parts:
        yield from _index_round(parts)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text): rows with equal id and key are taken together to their texts."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")


def build_index(docs: DataFrame) -> DataFrame:
    """The signature blocks of ``docs(doc_id, text)``, and by round the counts of
    documents, terms and documents by term; written to the shared folder."""
    with batch_bytes(docs.sparkSession, 4 << 20):
        return materialize(keyed(docs).select("doc_id", "key", "text").mapInArrow(B.frugal(_index), INDEX), "search-index")


class Queries:
    """A block of items: their ids, the hashes of their terms, and each item's terms."""

    def __init__(self, ids: list[Any], terms: np.ndarray, of: list[np.ndarray]):
        self.ids, self.terms, self.of = ids, terms, of
        self.weight = np.zeros(len(terms), np.int64)
        self.n_docs = self.n_terms = 0

    def weigh(self, df: dict[int, int], n_docs: int, n_terms: int) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        for i, n in df.items():
            self.weight[i] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))

    def slope(self, size: int) -> int:
        """The length term m of a document of ``size`` terms."""
        return 50 + (50 * size * self.n_docs) // self.n_terms

    def matrix(self) -> np.ndarray:
        out = np.zeros((len(self.of), len(self.terms)), np.float32)
        for i, own in enumerate(self.of):
            out[i, own] = self.weight[own]
        return out


def query_blocks(items: DataFrame) -> Iterator[Queries]:
    """Blocks of ``items(item_id, text)``; rows that share an item_id are one item."""
    texts = items.groupBy("item_id").agg(F.concat_ws(" ", F.sort_array(F.collect_set("text"))).alias("text")).orderBy("item_id")
    ids, held, seen = [], [], set()

    def made() -> Queries:
        terms = np.unique(np.concatenate(held))
        return Queries(list(ids), terms, [np.searchsorted(terms, x) for x in held])

    for row in texts.toLocalIterator():
        data = np.frombuffer(row["text"].encode(), np.uint8)
        own = np.unique(B.lane_hashes(B.Texts(data, np.array([0, len(data)])).words(B.ALNUM, lower=True)))
        if ids and (len(ids) >= QUERY_ITEMS or len(seen) + len(own) > QUERY_TERMS):
            yield made()
            ids, held, seen = [], [], set()
        ids.append(row["item_id"])
        held.append(own)
        seen.update(own.tolist())
    if seen:
        yield made()


def _frequencies(terms: np.ndarray):
    def count(batches):
        for batch in batches:
            total = np.zeros(len(terms), np.int64)
            for t, d in zip(batch.column("terms").to_pylist(), batch.column("dfs").to_pylist()):
                there, n = np.frombuffer(t, "<u8"), np.frombuffer(d, "<u4")
                at = np.minimum(np.searchsorted(there, terms), max(len(there) - 1, 0))
                if len(there):
                    total += np.where(there[at] == terms, n[at], 0)
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["term", "df"])
    return count


def _bounds(q: Queries, batches) -> Iterator[tuple[dict, np.ndarray]]:
    """The blocks, with the upper bounds of the scores (items x documents)."""
    weights = q.matrix()
    slack = 1 + 2.0 ** -22 * (1 + max(len(x) for x in q.of))  # of sums in single precision
    used = np.flatnonzero(q.weight)
    tops = [*(x - 1 for x in LEVELS[1:]), None]
    for batch in batches:
        for row in batch.to_pylist():
            n, width = len(row["sizes"]), row["width"]
            slices = np.frombuffer(row["slices"], np.uint8).reshape(width, -1)
            m = np.array([min(q.slope(s), 1 << 40) for s in row["sizes"]], np.int64)
            bound, before = np.zeros((len(q.of), n)), np.zeros(n, np.int64)
            terms, bits = used, None
            for level, most in enumerate(tops):
                at = _positions(q.terms[terms], level, width)
                now = slices[at[:, 0]]
                for k in range(1, HASHES):
                    now = now & slices[at[:, k]]
                bits = now if bits is None else bits & now
                some = np.flatnonzero(bits.any(axis=1))
                terms, bits = terms[some], bits[some]
                if not len(terms):
                    break
                impact = np.full(n, 1_000_000) if most is None else (1_000_000_000 * most) // (1_000 * most + 20 * m)
                there = np.unpackbits(bits, axis=1, count=n).astype(np.float32)
                bound += (weights[:, terms] @ there) * (impact - before)
                before = impact
            yield row, bound * slack


def _highest(q: Queries, top: int):
    """By task, the documents with the highest bounds of each item."""
    def run(batches):
        best = np.zeros((len(q.of), 0))
        place = np.zeros((len(q.of), 0), np.int64)
        ids, keys = [], []
        for row, bound in _bounds(q, batches):
            place = np.concatenate([place, np.broadcast_to(np.arange(len(ids), len(ids) + bound.shape[1]), bound.shape)], axis=1)
            best = np.concatenate([best, bound], axis=1)
            ids += row["doc_ids"]
            keys += row["keys"]
            if best.shape[1] > top:
                keep = np.argpartition(-best, top - 1, axis=1)[:, :top]
                best, place = np.take_along_axis(best, keep, 1), np.take_along_axis(place, keep, 1)
            if len(ids) > 1 << 20:  # forget documents that no item holds any more
                left, at = np.unique(place, return_inverse=True)
                ids, keys, place = [ids[i] for i in left], [keys[i] for i in left], at.reshape(place.shape)
        item, at = np.nonzero(best > 0)
        yield _chosen(item, [ids[i] for i in place[item, at]], [keys[i] for i in place[item, at]], best[item, at])
    return run


def _chosen(item, ids, keys, bound) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids, pa.int64()), pa.array(keys, pa.int64()),
                                       pa.array(bound, pa.float64())], ["item", "doc_id", "key", "bound"])


def _reaching(q: Queries, floor: np.ndarray):
    """All documents whose bound reaches the floor of an item."""
    def run(batches):
        for row, bound in _bounds(q, batches):
            item, at = np.nonzero((bound > 0) & (bound >= floor[:, None]))
            yield _chosen(item, [row["doc_ids"][i] for i in at], [row["keys"][i] for i in at], bound[item, at])
    return run


def _scored(q: Queries):
    """The scores of documents for the items that they are candidates of."""
    def run(batches):
        for batch in batches:
            for part, texts in B.text_chunks(batch):
                texts.words(B.ALNUM, lower=True)
                h = B.lane_hashes(texts)
                at = np.minimum(np.searchsorted(q.terms, h), len(q.terms) - 1)
                known = q.terms[at] == h
                out: list[tuple] = []
                for i, (doc_id, items) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("items").to_pylist())):
                    own = slice(texts.first[i], texts.first[i + 1])
                    tf = np.bincount(at[own][known[own]], minlength=len(q.terms)).astype(np.int64)
                    m = q.slope(int(own.stop - own.start))
                    for item in items:
                        n = tf[q.of[item]]
                        there = n > 0
                        n, w = n[there], q.weight[q.of[item]][there]
                        if m < 1 << 40:
                            score = int((w * ((1_000_000_000 * n) // (1_000 * n + 20 * m))).sum())
                        else:
                            score = sum(int(a) * ((10 ** 9 * int(b)) // (1_000 * int(b) + 20 * m)) for a, b in zip(w, n))
                        if score > 0:
                            out.append((item, doc_id, score))
                item, doc_id, score = zip(*out) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc_id, pa.int64()), pa.array(score, pa.int64())],
                                                 ["item", "doc_id", "score"])
    return run


def _score(docs: DataFrame, chosen: DataFrame, q: Queries) -> DataFrame:
    """Exact scores of the chosen (item, doc_id, key), from the texts."""
    wanted = materialize(chosen.groupBy("doc_id", "key").agg(F.collect_set("item").alias("items")), "search-wanted")
    few = wanted.count() <= BROADCAST_DOCS
    d, c = keyed(docs).alias("d"), (F.broadcast(wanted) if few else wanted).alias("c")
    texts = d.join(c, F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.key") == F.col("c.key")))
    return materialize(texts.select("d.doc_id", "d.text", "c.items").mapInArrow(
        B.frugal(_scored(q)), "item int, doc_id long, score long"), "search-scores")


def _first(rows: DataFrame, order: list, top: int, out: str = "rank") -> DataFrame:
    return rows.withColumn(out, F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col(out) <= top)


def search(docs: DataFrame, items: DataFrame, top: int = 50, index: DataFrame | None = None) -> DataFrame:
    """The ``top`` highest-scoring documents (doc_id, text) for each item (item_id, text).

    Terms are runs of digits, letters a-z (A-Z are lower-cased) and non-ASCII
    characters of the whole texts; a null text has none.  With N documents that have
    terms, L terms in all, n of a document, and a term in df of the documents, tf times
    in this one, a score sums w * ((10**9 * tf) div (1000 * tf + 20 * m)) over the item's
    different terms, where w = floor(1000 * ln((2N+2) / (2df+1))) and
    m = 50 + (50 * n * N) div L.

    Returns item_id, rank (from 1), doc_id, score; only scores above 0; equal scores
    by ascending doc_id (null first).  Rows that share a doc_id are documents of their
    own; rows that share an item_id (null too) are one item with the terms of all.
    Further columns are ignored.  Empty tables give no rows."""
    spark = docs.sparkSession
    index = build_index(docs) if index is None else index
    item_type = items.schema["item_id"].dataType
    found = []
    with batch_bytes(spark, 4 << 20):
        stats = index.where(F.col("kind") == STATS)
        n_docs, n_terms = stats.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        blocks = index.where(F.col("kind") == BLOCK).select("width", "doc_ids", "keys", "sizes", "slices")
        for q in query_blocks(items) if n_docs else ():
            df = stats.select("terms", "dfs").mapInArrow(_frequencies(q.terms), "term long, df long").groupBy("term").agg(F.sum("df"))
            q.weigh({r[0]: r[1] for r in df.collect()}, n_docs, n_terms)  # at most QUERY_TERMS rows
            picked = "item int, doc_id long, key long, bound double"
            seeds = _first(blocks.mapInArrow(_highest(q, FIRST * top), picked), [F.desc("bound"), "doc_id", "key"], FIRST * top)
            scored = _score(docs, seeds, q)
            floor = np.zeros(len(q.of))
            for r in _first(scored, [F.desc("score")], top).where(F.col("rank") == top).collect():  # a row for each item
                floor[r["item"]] = r["score"]
            reaching = blocks.mapInArrow(_reaching(q, floor), picked)
            ranked = _first(_score(docs, reaching, q), [F.desc("score"), F.asc_nulls_first("doc_id")], top)
            names = spark.createDataFrame(list(enumerate(q.ids)), T.StructType([T.StructField("item", T.IntegerType()),
                                                                               T.StructField("item_id", item_type)]))
            found.append(materialize(ranked.join(F.broadcast(names), "item").select(
                "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "search-found"))
    empty = spark.createDataFrame([], T.StructType([T.StructField("item_id", item_type), T.StructField("rank", T.IntegerType()),
                                                    T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))
    for one in found:
        empty = empty.union(one)
    return empty if len(found) != 1 else found[0]


def brute_force(docs: list[tuple], items: list[tuple], top: int = 50) -> list[tuple]:
    """(item_id, rank, doc_id, score) by plain loops, for tests."""
    import re
    from collections import Counter

    def terms(text):
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)

    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_terms = sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked: dict[Any, set] = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        scores = []
        for d, c in held:
            m = 50 + (50 * sum(c.values()) * len(held)) // n_terms
            score = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1)))
                        * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if score > 0:
                scores.append((-score, d is not None, d or 0))
        out += [(item, k + 1, d if real else None, -s) for k, (s, real, d) in enumerate(sorted(scores)[:top])]
    return out
