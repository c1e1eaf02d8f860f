"""Shards of near equal size from indivisible groups, by best-fit decreasing.

Groups are rows with equal texts.  Groups of at least 1 / ``GRAIN`` of all bytes
(so at most ``GRAIN`` of them) stand for themselves; the others are dealt by hash
over lots, and each lot packs its groups, best fit in decreasing size, into as few
bins of that fixed capacity as it can.  Large groups and bins, a number bounded by
a small multiple of ``GRAIN`` whatever the input, are then packed best fit
decreasing into the shards, with the smallest shard capacity that holds all."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.llm.common import gapless, materialize

GRAIN = 20_000
LOT_ROWS, MAX_LOTS = 20_000, 2_048


class Bins:
    """Open bins in a treap ordered by (remaining capacity, number)."""

    def __init__(self) -> None:
        self.root: list | None = None
        self.seed = 1

    def insert(self, key: tuple[int, int]) -> None:
        self.seed = self.seed * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
        low, high = self._split(self.root, key)
        self.root = self._join(self._join(low, [key, self.seed >> 16, None, None]), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least remaining capacity >= size."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        parent, node = None, high
        while node[2] is not None:
            parent, node = node, node[2]
        if parent is None:
            high = node[3]
        else:
            parent[2] = node[3]
        self.root = self._join(low, high)
        return node[0]

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            node[3], high = self._split(node[3], key)
            return node, high
        low, node[2] = self._split(node[2], key)
        return low, node

    def _join(self, low, high):
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            low[3] = self._join(low[3], high)
            return low
        high[2] = self._join(low, high[2])
        return high


def best_fit_decreasing(sizes: list[int], capacity: int, at_most: int | None = None) -> list[int] | None:
    """The bin of each size (in decreasing order, given so); a size above the
    capacity has a bin of its own.  None if more than ``at_most`` bins are needed."""
    bins, used, out = Bins(), 0, []
    for size in sizes:
        found = bins.take_tightest(size) if size <= capacity else None
        if found is None:
            if used == at_most:
                return None
            found = (max(capacity, size), used)
            used += 1
        out.append(found[1])
        bins.insert((found[0] - size, found[1]))
    return out


def into_shards(sizes: list[int], shards: int) -> list[int]:
    """Best-fit decreasing into ``shards`` bins of the least capacity that a
    bisection finds to be enough."""
    alone, rest = 0, sum(sizes)
    while alone < min(len(sizes), shards - 1) and sizes[alone] * (shards - alone) > rest:
        rest -= sizes[alone]  # above the mean of what is left: a shard of its own
        alone += 1
    if alone:
        return [*range(alone), *(alone + s for s in into_shards(sizes[alone:], shards - alone))]
    low = max(-(-rest // shards), max(sizes, default=0))
    high = low
    while (best := best_fit_decreasing(sizes, high, shards)) is None:
        high += max(1, low // 50)
    low -= 1
    while high - low > max(1, high // 1_000_000):
        middle = (low + high) // 2
        found = best_fit_decreasing(sizes, middle, shards)
        low, high, best = (middle, high, best) if found is None else (low, middle, found)
    return best


def _lot(capacity: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "key"], ascending=[False, True], ignore_index=True)
        rows["bin"] = best_fit_decreasing(rows["bytes"].tolist(), capacity)
        return rows[["key", "lot", "bin", "bytes"]]
    return pack


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Put ``docs(doc_id, text, ...)`` into ``shards`` shards of near equal bytes.

    A row's size is its UTF-8 bytes (null: none) plus 1.  Rows with equal texts
    (null texts too) share a shard.  A group above the mean shard size makes its
    shard larger than others; all else is spread evenly.

    Returns doc_id, size, text_crc32 (null text: 0), law 'bytes', shard, slot
    (gapless from 0 in each shard, for all rows, repeated ones too), and
    grown_shard, null under this law.  Null doc_ids are ordinary rows.  Other
    columns are left out.  An empty table gives an empty table."""
    spark = docs.sparkSession
    rows = materialize(docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), F.lit(b"")).alias("key")), "shard-rows")
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups")
    n, total = groups.agg(F.count("key"), F.sum("bytes")).first()
    n_rows = rows.count()
    grain = max(1, -(-(total or 0) // GRAIN))
    lots = min(MAX_LOTS, max(1, -(-n // LOT_ROWS)))
    large = groups.where(F.col("bytes") >= grain)
    binned = materialize(groups.where(F.col("bytes") < grain)
                         .withColumn("lot", F.pmod(F.xxhash64("key"), F.lit(lots)).cast("int"))
                         .groupBy("lot").applyInPandas(_lot(grain), "key binary, lot int, bin int, bytes long"), "shard-bins")
    items = [(r["bytes"], bytes(r["key"]), -1, -1) for r in large.collect()]
    items += [(r["bytes"], b"", r["lot"], r["bin"]) for r in
              binned.groupBy("lot", "bin").agg(F.sum("bytes").alias("bytes")).collect()]
    items.sort(key=lambda x: (-x[0], *x[1:]))
    dealt = list(zip(items, into_shards([x[0] for x in items], shards)))
    # at most GRAIN groups, and two bins for each grain and one for each lot
    of_large = spark.createDataFrame([(x[1], s) for x, s in dealt if x[2] < 0], "key binary, shard int")
    of_bin = spark.createDataFrame([(x[2], x[3], s) for x, s in dealt if x[2] >= 0], "lot int, bin int, shard int")
    of_group = materialize(large.select("key").join(F.broadcast(of_large), "key").union(
        binned.join(F.broadcast(of_bin), ["lot", "bin"]).select("key", "shard")), "shard-groups")
    ranked = gapless(rows.join(of_group, "key"), ["shard"], [F.col(c) for c in ("doc_id", "size", "text_crc32", "key")],
                     F.xxhash64("doc_id", "key"), max(64, n_rows // 20_000), "slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
