"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits share a variant that lies within half the
radius of both.  Every fingerprint emits all variants with up to ``radius // 2``
bits flipped.  An odd radius leaves pairs at exactly that distance: one of them
has an odd number of ones, and it also emits variants with one more bit flipped;
of ``2 k + 1`` differing bits, ``k + 1`` lie in the same half of the word, so
flips within one half are enough.  Rows are shuffled on variants; a variant's
near fingerprints are all within the radius of whatever else meets there, so a
star around one of them keeps every connection, without emitting all pairs.  At
most a ball of different fingerprints meets in a variant, whatever the data.

Equal fingerprints are joined into one before, and fingerprints whose halves have
no other fingerprint within ``radius // 2`` bits, which have no partner at all,
emit nothing (with very many fingerprints, some 10**8, nearly all halves have
one, and then this step saves nothing)."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.llm import bytetext as B
from cartwise.llm.common import batch_rows, components, materialize, small_batches

#: Byte -> eight lanes of one byte, one for each bit.
SPREAD = np.array([sum(1 << (8 * j) for j in range(8) if i >> j & 1) for i in range(256)], np.uint64)

#: A key is the high half of a word, or the low half under a tag.
LOW, LOW_TAG = np.uint64(0xFFFFFFFF), np.uint64(1 << 32)


def shingle_hashes(text: bytes, size: int) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    whole = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(whole, 42)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-size] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(whole[a:b], 42) for a, b in zip(starts, ends[size - 1:].tolist())]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprint of each text from its hashes (``counts`` of them)."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    ends = np.cumsum(counts[some])
    blocks = [np.arange(e - n, e, 255) for e, n in zip(ends, counts[some])]
    lanes = SPREAD[hashes.view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, np.concatenate(blocks), axis=0).view(np.uint8)
    firsts = np.cumsum([0, *map(len, blocks[:-1])])
    ones = np.add.reduceat(sums.astype(np.int64), firsts, axis=0)
    bits = (2 * ones > counts[some][:, None]).astype(np.uint8)
    out[some] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _fingerprints(size: int):
    def run(batches):
        for batch in batches:
            for part, texts in B.text_chunks(batch):
                found = [shingle_hashes(texts.data[a:b].tobytes(), size)
                         for a, b in zip(texts.offsets[:-1], texts.offsets[1:])]
                hashes = np.array([h for own in found for h in own], np.uint64)
                prints = majority(hashes, np.array([len(own) for own in found]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("version"), pa.array(prints.view(np.int64))],
                                                 ["doc_id", "version", "print"])
    return run


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, version, print): 64-bit SimHash of ``size``-word shingles, repeats
    included; ``version`` is a hash of the text."""
    small_batches(docs.sparkSession)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("version"), "text")
    return keyed.mapInArrow(B.frugal(_fingerprints(size)), "doc_id long, version long, print long")


def flips(bits: range, n: int) -> np.ndarray:
    """Words with exactly ``n`` of the given bits set."""
    return np.array([sum(1 << b for b in own) for own in combinations(bits, n)], np.uint64)


def ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _halves(near: int):
    """(key, print): each half with up to ``near`` bits flipped."""
    masks = np.concatenate([flips(range(32), k) for k in range(near + 1)])

    def run(batches):
        for batch in batches:
            prints = B.names_of(batch.column("print")).view(np.uint64)
            for half, place in ((prints & LOW, LOW_TAG), (prints >> np.uint64(32), np.uint64(0))):
                keys = (half[:, None] ^ masks[None, :]) | place
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.reshape(-1).view(np.int64)),
                     pa.array(np.repeat(prints, len(masks)).view(np.int64))], ["key", "print"])
    return run


def _variants(radius: int):
    near = radius // 2
    ball = np.concatenate([flips(range(64), k) for k in range(near + 1)])
    more = np.concatenate([flips(range(lo, lo + 32), near + 1) for lo in (0, 32)])

    def run(batches):
        for batch in batches:
            prints = B.names_of(batch.column("print")).view(np.uint64)
            for at in range(0, len(prints), 256):
                own = prints[at:at + 256]
                pieces = [(own, ball)] + ([(own[ones(own) % 2 == 1], more)] if radius % 2 else [])
                for who, mask in pieces:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((who[:, None] ^ mask[None, :]).reshape(-1).view(np.int64)),
                         pa.array(np.repeat(who, len(mask)).view(np.int64))], ["variant", "print"])
    return run


def _stars(radius: int):
    """Verified links (a, b) from rows sorted by variant: the smallest near
    fingerprint of a variant with every other one there."""
    def links(variant: np.ndarray, prints: np.ndarray):
        near = ones(variant ^ prints) <= radius // 2
        first = np.flatnonzero(np.append(True, variant[1:] != variant[:-1]))
        centre = np.minimum.reduceat(np.where(near, prints, np.uint64(0xFFFFFFFFFFFFFFFF)), first)
        some = np.logical_or.reduceat(near, first)
        n = np.diff(np.append(first, len(variant)))
        a, ok = np.repeat(centre, n), np.repeat(some, n)
        ok &= (a != prints) & (ones(a ^ prints) <= radius)
        return pa.RecordBatch.from_arrays([pa.array(a[ok].view(np.int64)), pa.array(prints[ok].view(np.int64))], ["a", "b"])

    def run(batches):
        kept = np.zeros((2, 0), np.uint64)
        for batch in batches:
            new = np.stack([B.names_of(batch.column(c)).view(np.uint64) for c in ("variant", "print")])
            kept = np.concatenate([kept, new], axis=1)
            if not kept.shape[1]:
                continue
            cut = np.searchsorted(kept[0].view(np.int64), kept[0].view(np.int64)[-1])
            if cut:
                yield links(*kept[:, :cut])
                kept = kept[:, cut:]
        if kept.shape[1]:
            yield links(*kept)
    return run


def links(prints: DataFrame, radius: int, parts: int) -> DataFrame:
    """Links (a, b) between different fingerprints ``prints(print)``: enough of
    those within ``radius`` bits to connect all that are connected."""
    near = radius // 2
    prints = prints.repartition(parts, "print")  # else few tasks would hold all variants
    met = (prints.mapInArrow(B.frugal(_halves(near)), "key long, print long").groupBy("key")
           .agg(F.min("print").alias("lo"), F.max("print").alias("hi")).where("lo < hi").select("key"))
    own = prints.select("print", F.explode(F.array(
        F.col("print").bitwiseAND(F.lit(int(LOW))).bitwiseOR(F.lit(int(LOW_TAG))),
        F.shiftrightunsigned("print", 32))).alias("key"))
    some = materialize(own.join(met, "key", "left_semi").select("print").distinct(), "simhash-candidates")
    return (some.mapInArrow(B.frugal(_variants(radius)), "variant long, print long")
            .repartition(parts, "variant").sortWithinPartitions("variant")
            .mapInArrow(B.frugal(_stars(radius)), "a long, b long").distinct())


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """Classes of near-duplicates of ``docs(doc_id, text, ...)``.

    Texts (A-Z lower-cased) are split at [\\x20\\x09-\\x0D]; a fingerprint bit is
    set if it is set in over half of the XXH64 hashes (seed 42) of the
    ``size``-word shingles, repeats included; fewer words make one shingle, no
    words (null, empty or blank text) the fingerprint zero, which links like any
    other.  Fingerprints at most ``radius`` bits apart are linked.

    Returns one row per row of ``docs``: doc_id, fingerprint (16 hex digits) and
    component_id, the smallest doc_id reachable over links.  Rows that share a
    doc_id are linked by their own fingerprints only.  Rows with a null
    doc_id get the component of their fingerprint's other rows, if there are any
    (else null).  Other columns are left out.  An empty table gives an empty
    table."""
    return _classes(docs, size, radius).select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def _classes(docs: DataFrame, size: int, radius: int) -> DataFrame:
    """(doc_id, version, print, component_id), one row per row of ``docs``."""
    spark = docs.sparkSession
    found = materialize(fingerprints(docs, size), "simhash")
    prints = materialize(found.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("first")), "prints")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with batch_rows(spark, 20_000):
        edges = materialize(links(prints.select("print"), radius, parts), "simhash-links")
        # rows that share a doc_id may differ in their texts, so classes are fingerprints
        classes = components(prints.select(F.col("print").alias("node")), edges.select("a", "b"), "simhash")
        joined = materialize(prints.join(classes, prints["print"] == classes["node"])
                             .select("print", "first", "component"), "simhash-components")
        least = materialize(joined.groupBy("component").agg(F.min("first").alias("component_id")), "simhash-least")
        of_print = materialize(joined.join(least, "component").select("print", "component_id"), "simhash-classes")
    return found.join(of_print, "print", "left").select("doc_id", "version", "print", "component_id")


def keep_one(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its class, and rows with a
    null doc_id; columns as in ``docs``.  Rows that share a doc_id are kept or dropped
    each by its own text; repeated rows alike."""
    gone = (_classes(docs, size, radius).where("doc_id <> component_id")
            .select("doc_id", F.col("version").alias("__version")).distinct())
    kept = docs.drop("__version").withColumn("__version", F.xxhash64("text"))
    return kept.join(gone, ["doc_id", "__version"], "left_anti").select(*(c for c in docs.columns if c != "__version"))


def brute_force(rows: list[tuple[int, str | None]], size: int = 3, radius: int = 3) -> dict[int, tuple]:
    """The same result by plain loops, for tests."""
    prints = {}
    for d, text in rows:
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    parent = {d: d for d in prints}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d
    for a, b in combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return {d: (f"{p:016x}", top(d)) for d, p in prints.items()}
