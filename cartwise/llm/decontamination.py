"""Benchmark decontamination with an FM-index for each training shard.

A shard is a run of documents that a scan task holds at once.  Its words are
numbered by the benchmark's vocabulary; a word outside it ends a text, as does
the end of a document, and texts too short for any test phrase are left out.  The
index is the Burrows-Wheeler transform of these texts in a wavelet tree (bit rows
with rank counts), with every ``SAMPLE``-th suffix position stored.  All test
phrases search backwards together; rows found are located by stepping to sampled
positions; removal spans of a document are merged.

The benchmark is the query set: it is handled in blocks of at most
``BLOCK_WORDS`` words, each a pass over the documents, so that what every task
gets is bounded."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwise.llm import bytetext as B
from cartwise.llm.common import materialize, small_batches

SAMPLE = 8
BLOCK_WORDS = 1 << 20


class Bits:
    """A bit row with ranks: ones before each 64-bit word are stored."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n + 64) // 64 * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.words).astype(np.int64)))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place ``i``."""
        w, b = i >> 6, (i & 63).astype(np.uint64)
        part = self.words[w] & ((np.uint64(1) << b) - np.uint64(1))
        return self.before[w] + np.bitwise_count(part)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class WaveletTree:
    """Ranks and symbols of a sequence: one bit row for each bit of a symbol, from
    the highest; each level keeps zeros before ones."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels: list[tuple[Bits, int]] = []
        self.depth = max(1, int(size - 1).bit_length())
        for k in range(self.depth - 1, -1, -1):
            bit = (symbols >> k & 1).astype(bool)
            self.levels.append((Bits(bit), int(len(bit) - bit.sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before place ``i``."""
        start = np.zeros_like(i)
        for k, (bits, zeros) in zip(range(self.depth - 1, -1, -1), self.levels):
            one = (symbol >> k & 1).astype(bool)
            a, b = bits.rank(start), bits.rank(i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
        return i - start

    def get(self, i: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(i)
        for bits, zeros in self.levels:
            one, before = bits.get(i), bits.rank(i)
            symbol = symbol << 1 | one
            i = np.where(one == 1, zeros + before, i - before)
        return symbol


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Sorted suffixes, by doubling the compared prefix until all differ."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        second = np.zeros(n, np.int64)
        second[:n - width] = rank[width:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        place = np.append(0, np.cumsum(sorted_key[1:] != sorted_key[:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = place
        if place[-1] == n - 1:
            return order
        width *= 2
        if width >= n:
            return order


class FMIndex:
    """Backward search over ``text`` (symbols below ``size``; 0 ends a text)."""

    def __init__(self, text: np.ndarray, size: int):
        # a symbol that occurs once, at the end, makes all suffixes different
        text = np.append(text + 1, 0)
        order = suffix_array(text)
        self.n = len(text)
        last = text[order - 1]
        self.tree = WaveletTree(last, size + 1)
        self.starts = np.append(0, np.cumsum(np.bincount(text, minlength=size + 1)))
        sampled = order % SAMPLE == 0
        self.sampled, self.positions = Bits(sampled), order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of the suffixes that start with each phrase (all of
        one length: a row of symbols each)."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        for symbol in phrases.T[::-1] + 1:
            low = self.starts[symbol] + self.tree.rank(symbol, low)
            high = self.starts[symbol] + self.tree.rank(symbol, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by stepping back to sampled ones."""
        out, steps = np.empty(len(rows), np.int64), 0
        left = np.arange(len(rows))
        while len(left):
            done = self.sampled.get(rows).astype(bool)
            out[left[done]] = self.positions[self.sampled.rank(rows[done])] + steps
            left, rows = left[~done], rows[~done]
            symbol = self.tree.get(rows)
            rows = self.starts[symbol] + self.tree.rank(symbol, rows)
            steps += 1
        return out


class Benchmark:
    """The windows of some items, in numbers of their vocabulary (from 1)."""

    def __init__(self, items: list[tuple[int, bytes]], width: int):
        data = np.frombuffer(b"".join(t for _, t in items), np.uint8)
        offsets = np.cumsum([0, *(len(t) for _, t in items)])
        words = B.Texts(data, offsets).words(B.ALNUM, lower=True)
        self.vocabulary, numbers = np.unique(words.hashes(), return_inverse=True)
        numbers = numbers + 1
        self.item_ids = [i for i, _ in items]
        found: dict[tuple[int, ...], set[int]] = {}
        for k in range(len(items)):
            own = numbers[words.first[k]:words.first[k + 1]].tolist()
            for at in range(max(1, len(own) - width + 1) if own else 0):
                found.setdefault(tuple(own[at:at + width]), set()).add(k)
        self.by_length: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for n in sorted({len(w) for w in found}):
            own = [(w, sorted(k)) for w, k in found.items() if len(w) == n]
            self.by_length[n] = np.array([w for w, _ in own], np.int64), [k for _, k in own]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary numbers of document words; 0 is any other word."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def occurrences(words: B.Texts, benchmark: Benchmark) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """First word, length and items of every occurrence of a window in a shard."""
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64), []
    if not benchmark.by_length or not len(words.starts):
        return nothing
    numbers = benchmark.numbers(words.hashes())
    # texts: runs of benchmark words within a document
    inside = numbers > 0
    begins = inside & np.append(True, ~inside[:-1] | (words.doc[1:] != words.doc[:-1]))
    ends = inside & np.append(~inside[1:] | (words.doc[1:] != words.doc[:-1]), True)
    first, after = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    long_enough = after - first >= min(benchmark.by_length)
    first, after = first[long_enough], after[long_enough]
    if not len(first):
        return nothing
    sizes = after - first + 1  # with the end of the text
    place = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    text = np.append(numbers, 0)[np.minimum(place, len(numbers))]
    text[np.cumsum(sizes) - 1] = 0
    index = FMIndex(text, len(benchmark.vocabulary) + 1)
    found = [nothing]
    for length, (phrases, items) in benchmark.by_length.items():
        low, high = index.search(phrases)
        hits = np.flatnonzero(high > low)
        n = (high - low)[hits]
        rows = np.repeat(low[hits] - np.cumsum(n) + n, n) + np.arange(n.sum())
        found.append((place[index.locate(rows)], np.full(len(rows), length), [items[k] for k in np.repeat(hits, n)]))
    at, length, items = zip(*found)
    return np.concatenate(at), np.concatenate(length), [x for own in items for x in own]


#: What ``_with_spans`` adds: number of words, merged spans, item ids.
ADDED = ("__n", "__spans", "__items")
#: The hash of a text: rows may share a doc_id but not a text.
VERSION = "__version"


def _spans(shared):
    """Per document: its words, merged spans of hit words [first, after), items."""
    def run(batches):
        benchmark = shared.value
        for batch in batches:
            for part, texts in B.text_chunks(batch):
                words = texts.words(B.ALNUM, lower=True)
                at, length, items = occurrences(words, benchmark)
                owner = words.doc[at] if len(at) else at
                spans: list[list] = [[] for _ in range(len(texts))]
                held: list[set] = [set() for _ in range(len(texts))]
                for k in np.lexsort((at, owner)):
                    d, a = owner[k], int(at[k] - words.first[owner[k]])
                    held[d].update(items[k])
                    if spans[d] and a <= spans[d][-1][1]:
                        spans[d][-1][1] = max(spans[d][-1][1], a + int(length[k]))
                    else:
                        spans[d].append([a, a + int(length[k])])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in part.schema.names),
                     pa.array(np.diff(words.first), pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))),
                     pa.array([sorted(str(benchmark.item_ids[k]) for k in own) for own in held], pa.list_(pa.string()))],
                    [*part.schema.names, *ADDED])
    return run


def blocks(benchmark: DataFrame, width: int) -> Iterator[Benchmark]:
    """The benchmark in blocks of at most ``BLOCK_WORDS`` words (or one item)."""
    items = benchmark.where("item_id is not null and text is not null").select(
        F.col("item_id").cast("long"), F.col("text").cast("binary"))
    held, n = [], 0
    for item_id, text in items.orderBy("item_id", "text").toLocalIterator():
        if held and n + len(text) // 2 > BLOCK_WORDS:
            yield Benchmark(held, width)
            held, n = [], 0
        held.append((item_id, bytes(text)))
        n += len(text) // 2
    yield Benchmark(held, width)


def _with_spans(docs: DataFrame, benchmark: DataFrame, width: int) -> DataFrame:
    """All columns of ``docs``, n_words, merged spans and item ids."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop(*ADDED, VERSION)
    version = F.sha2(F.col("text").cast("binary"), 256).alias(VERSION)
    extra = [T.StructField(n, T._parse_datatype_string(t)) for n, t in zip(
        ADDED, ("long", "array<array<int>>", "array<string>"))]

    def found(own: DataFrame, block) -> DataFrame:
        return own.mapInArrow(B.frugal(_spans(block)), T.StructType([*own.schema, *extra]))
    first, more = None, []
    for block in blocks(benchmark, width):
        shared = spark.sparkContext.broadcast(block)
        if first is None:
            first = found(docs, shared)
            continue
        # later blocks add spans and items of the (doc_id, text) that hold any, once for repeated rows
        some = found(docs.select("doc_id", "text"), shared).where("size(__spans) > 0")
        more.append(materialize(some.select("doc_id", version, "__spans", "__items").dropDuplicates(["doc_id", VERSION]), "spans"))
        shared.unpersist()
    if not more:
        return first
    more = reduce(DataFrame.unionAll, more).groupBy(F.col("doc_id").alias("__d"), F.col(VERSION).alias("__v")).agg(
        F.flatten(F.collect_list("__spans")).alias("__s"), F.flatten(F.collect_list("__items")).alias("__i"))
    wide = first.withColumn(VERSION, version).join(
        more, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col(VERSION) == F.col("__v")), "left")
    every = F.array_sort(F.concat("__spans", F.coalesce("__s", F.array())))
    last = F.lit(-1)
    merged = F.aggregate(every, F.array().cast("array<array<int>>"), lambda done, s: F.when(
        F.get(F.try_element_at(done, last), F.lit(1)) >= s[0],
        F.concat(F.slice(done, 1, F.size(done) - 1),
                 F.array(F.array(F.try_element_at(done, last)[0], F.greatest(F.try_element_at(done, last)[1], s[1])))
                 )).otherwise(F.concat(done, F.array(s))))
    return wide.select(*docs.columns, "__n", merged.alias("__spans"),
                       F.array_sort(F.array_distinct(F.concat("__items", F.coalesce("__i", F.array())))).alias("__items"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Words of ``docs(doc_id, text, ...)`` inside windows of ``benchmark(item_id, text)``.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased.
    A window is ``width`` consecutive words of an item; an item of fewer words,
    but not none, is one window.

    Returns all columns of ``docs`` with n_words, n_hit, n_items, items (ids as
    sorted strings), spans (merged, [first, after) in words) and contaminated
    added (columns of these names are replaced).  Null and empty texts have no
    words; a null item or item text has no windows; repeated documents and items
    are found alike; an empty benchmark hits nothing, an empty table gives an
    empty table.  Rows are told apart by doc_id and text, so doc_ids may be null or
    shared however many blocks of items there are."""
    hit = F.aggregate("__spans", F.lit(0), lambda n, s: n + s[1] - s[0])
    return _with_spans(docs, benchmark, width).withColumns({
        "n_words": F.col("__n"), "n_hit": hit.cast("long"), "n_items": F.size("__items").cast("long"),
        "items": F.col("__items"), "spans": F.col("__spans"), "contaminated": F.size("__spans") > 0}).drop(*ADDED)


def _cut(batches):
    for batch in batches:
        for part, texts in B.text_chunks(batch):
            words = texts.words(B.ALNUM, lower=True)
            data = part.column("text").to_pylist()
            for d, own in enumerate(part.column("__spans").to_pylist()):
                if own:
                    raw, first, zero = data[d].encode(), words.first[d], texts.offsets[d]
                    kept, at = [], 0
                    for a, b in own:
                        kept.append(raw[at:words.starts[first + a] - zero])
                        at = words.ends[first + b - 1] - zero
                    data[d] = b"".join([*kept, raw[at:]]).decode("utf-8", "replace")
            names = [n for n in part.schema.names if n != "__spans"]
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.string()) if n == "text" else part.column(n) for n in names], names)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """``docs`` without the text of each merged span, from its first word's start
    to its last word's end; columns and rows as in ``docs``."""
    wide = _with_spans(docs, benchmark, width).drop("__n", "__items")
    return wide.mapInArrow(B.frugal(_cut), T.StructType([f for f in wide.schema if f.name != "__spans"]))


def digest(found: DataFrame) -> DataFrame:
    """What query op3 returns."""
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def brute_force(docs, items, width: int = 10) -> dict[int, tuple]:
    """The same result by plain loops, for tests."""
    import re
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def split(text):
        return word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    windows: dict[tuple, set] = {}
    for i, text in items:
        w = split(text)
        for at in range(max(1, len(w) - width + 1) if w and i is not None else 0):
            windows.setdefault(tuple(w[at:at + width]), set()).add(str(i))
    out = {}
    for d, text in docs:
        w, hit, held = split(text), set(), set()
        for n in {len(x) for x in windows}:
            for at in range(len(w) - n + 1):
                own = windows.get(tuple(w[at:at + n]))
                if own:
                    held |= own
                    hit |= set(range(at, at + n))
        out[d] = (len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit))
    return out
