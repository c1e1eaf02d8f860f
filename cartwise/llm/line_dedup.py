"""Line deduplication with two Bloom filters.

Every scan task fills two filters for its part of the documents: bits of line
hashes seen once, and bits seen twice.  Merged segment by segment (a bit is
"twice" if it is twice in one part or once in two), the twice-filter holds every
repeated line and few others.  Only lines that hit it are shuffled, with their
whole key, to be counted exactly; ties are settled by the largest document id.

Filters are sized from the number of lines.  Beyond ``max_filter_bits`` the hash
space is handled in slices, one pair of filters after the other, so that what is
broadcast never exceeds ``max_filter_bits / 8`` bytes."""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.llm.bytetext import frugal
from cartwise.llm.common import materialize, small_batches

BLANK = b" \t\n\x0b\x0c\r"
SEGMENT_BITS = 1 << 17
BITS_PER_LINE = 16
PROBES = 4


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line, or None if it has fewer than ``min_chars`` characters."""
    key = line.strip(BLANK)
    if len(key) < min_chars:
        return None
    if len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key.lower()


def doc_keys(text: bytes | None, min_chars: int) -> dict[bytes, list[int]]:
    """The distinct keys of a document, each with the places of its lines."""
    keys: dict[bytes, list[int]] = {}
    for i, line in enumerate((text or b"").split(b"\n")):
        key = line_key(line, min_chars)
        if key is not None:
            keys.setdefault(key, []).append(i)
    return keys


def probes(keys: list[bytes], bits: int, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit places (one row per key) and the slice of each key."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    places = (low[:, None] + high[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(bits)
    return places, (h >> np.uint64(7)) % np.uint64(slices)


def _once_twice(bits: int, slices: int, at: int, min_chars: int):
    """Per task: sparse bit places seen once and twice, by filter segment."""
    def fill(batches):
        seen: list[np.ndarray] = []
        twice = np.zeros(0, np.uint64)
        for batch in batches:
            keys = [k for t in batch.column("text").to_pylist() for k in doc_keys(t, min_chars)]
            places, own = probes(keys, bits, slices)
            # a key's places count once each, also where two of its probes meet
            places = np.sort(places[own == at], axis=1)
            fresh = np.ones(places.shape, bool)
            fresh[:, 1:] = places[:, 1:] != places[:, :-1]
            seen.append(places[fresh])
            if sum(map(len, seen)) > 4_000_000:
                once, again = _fold(seen)
                seen, twice = [once, again], np.union1d(twice, again)
        once, again = _fold(seen)
        twice = np.union1d(twice, again).astype(np.uint64)
        for s in np.unique(once // np.uint64(SEGMENT_BITS)):
            lo, hi = np.uint64(s * SEGMENT_BITS), np.uint64((s + 1) * SEGMENT_BITS)
            a = once[np.searchsorted(once, lo):np.searchsorted(once, hi)] - lo
            b = twice[np.searchsorted(twice, lo):np.searchsorted(twice, hi)] - lo
            yield pa.RecordBatch.from_pydict({"segment": [int(s)], "once": [a.astype("<u4").tobytes()],
                                              "twice": [b.astype("<u4").tobytes()]})
    return fill


def _fold(seen: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places, and those that occur more than once."""
    every = np.concatenate(seen) if seen else np.zeros(0, np.uint64)
    places, n = np.unique(every, return_counts=True)
    return places, places[n > 1]


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    """One segment of the twice-filter from the parts' once and twice places."""
    count = np.zeros(SEGMENT_BITS, np.uint8)
    for once, twice in zip(rows["once"], rows["twice"]):
        count[np.frombuffer(once, "<u4")] += 1
        np.minimum(count, 2, out=count)
        count[np.frombuffer(twice, "<u4")] = 2
    return pd.DataFrame({"segment": rows["segment"].iloc[:1], "bits": [np.packbits(count > 1).tobytes()]})


def suspects(docs: DataFrame, bits: int, slices: int, at: int, min_chars: int) -> DataFrame:
    """(key, doc_id, version, lines) of the lines whose key may occur in two documents."""
    spark = docs.sparkSession
    parts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(
        frugal(_once_twice(bits, slices, at, min_chars)), "segment long, once binary, twice binary")
    merged = parts.groupBy("segment").applyInPandas(_merge, "segment long, bits binary").collect()
    table = np.zeros((bits // SEGMENT_BITS, SEGMENT_BITS // 8), np.uint8)
    for row in merged:
        table[row["segment"]] = np.frombuffer(row["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(table.reshape(-1))

    def probe(batches):
        twice = shared.value
        for batch in batches:
            out = {"key": [], "doc_id": [], "version": [], "lines": []}
            for doc_id, version, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "version", "text"))):
                keys = doc_keys(text, min_chars)
                if not keys:
                    continue
                names = list(keys)
                places, own = probes(names, bits, slices)
                hit = (own == at) & ((twice[(places >> np.uint64(3)).astype(np.int64)]
                                      >> (7 - (places & np.uint64(7))).astype(np.uint8)) & 1).all(axis=1)
                for i in np.flatnonzero(hit):
                    out["key"].append(names[i])
                    out["doc_id"].append(doc_id)
                    out["version"].append(version)
                    out["lines"].append(keys[names[i]])
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema(
                [("key", pa.binary()), ("doc_id", pa.int64()), ("version", pa.int64()), ("lines", pa.list_(pa.int32()))]))

    found = materialize(docs.select("doc_id", "version", F.col("text").cast("binary").alias("text")).mapInArrow(
        frugal(probe), "key binary, doc_id long, version long, lines array<int>"), "line-suspects")
    shared.unpersist()
    return found


def repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5,
                   max_filter_bits: int = 1 << 30,
                   bits_per_line: int = BITS_PER_LINE) -> DataFrame:
    """(doc_id, version, dropped): the places of the lines that each document loses.
    ``version`` is a hash of the text: rows that share a doc_id are one document."""
    small_batches(docs.sparkSession)
    lines = docs.agg(F.sum(F.least(
        F.octet_length("text") / min_chars,
        F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).alias("n")).first()["n"] or 1
    wanted = max(SEGMENT_BITS, 1 << max(0, math.ceil(math.log2(bits_per_line * lines))))
    slices = max(1, wanted // max(max_filter_bits, SEGMENT_BITS))
    found = reduce(DataFrame.unionAll, [
        suspects(docs, wanted // slices, slices, at, min_chars) for at in range(slices)])
    repeated = materialize(found.groupBy("key").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"))
                           .where(F.col("n_docs") >= min_docs).select("key", "keeper"), "line-repeats")
    return (found.join(repeated, "key").where("doc_id < keeper")
            .groupBy("doc_id", "version").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("dropped")))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5,
                max_filter_bits: int = 1 << 30, bits_per_line: int = BITS_PER_LINE) -> DataFrame:
    """Drop repeated lines from ``docs(doc_id, text, ...)``.

    A line's key is the line without white space at both ends, A-Z lower-cased.
    Keys of at least ``min_chars`` characters found in at least ``min_docs``
    documents keep their lines only in the largest ``doc_id`` holding them (all
    of them there); other lines stay.  Rows that share a doc_id
    count as one document and are rewritten each by its own text.

    Returns all columns of ``docs``, with ``text`` rewritten and ``n_lines``
    (before) and ``n_dropped`` added (input columns of these names are replaced).
    A null or empty text is one empty line; a null text stays null.  Rows with a
    null ``doc_id`` keep all lines and confirm no repeats.  An empty table gives
    an empty table."""
    docs = docs.drop("n_lines", "n_dropped", "__gone", "__version")
    version = F.xxhash64("text")
    keyed = docs.where(F.col("doc_id").isNotNull()).select("doc_id", version.alias("version"), "text")
    gone = repeated_lines(keyed, min_chars, min_docs, max_filter_bits, bits_per_line)
    gone = gone.select("doc_id", F.col("version").alias("__version"), F.col("dropped").alias("__gone"))
    wide = docs.withColumn("__version", version).join(gone, ["doc_id", "__version"], "left").select(*docs.columns, "__gone")
    lines = F.split("text", "\n", -1)
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__gone")
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n"))
    n_lines = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))), F.lit(0)) + 1
    return wide.withColumns({"n_lines": n_lines.cast("long"), "text": text,
                             "n_dropped": F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long")}).drop("__gone")


def digest(docs: DataFrame) -> DataFrame:
    """What query op1 returns."""
    return docs.select("doc_id", "n_lines", "n_dropped",
                       F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], min_chars: int = 40, min_docs: int = 5) -> dict[int, tuple]:
    """The same result by plain loops, for tests."""
    holders: dict[bytes, set[int]] = {}
    for doc_id, text in rows:
        for key in doc_keys((text or "").encode(), min_chars):
            holders.setdefault(key, set()).add(doc_id)
    out = {}
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not ((k := line_key(x.encode(), min_chars)) is not None
                                         and len(holders[k]) >= min_docs and max(holders[k]) != doc_id)]
        out[doc_id] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out
