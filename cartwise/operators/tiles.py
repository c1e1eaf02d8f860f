"""Counting the item pairs of customers in tiles.

Items, by number, are dealt into ``blocks`` by a hash; tile (i, j), i <= j, counts the pairs
of an item of block i and one of block j.  A customer's items of two blocks go to their
tile once, whatever their pairs, so what is shuffled grows with purchases times blocks.
A tile also gets the names of its two blocks' items: counted pairs are named in place."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs (with their repeats) of a tile on average; tiles at least (or the shuffle partitions, if fewer).
TILE_PAIRS, LEAST_TILES = 16_000_000, 12
#: Pairs held before equal ones are summed; rows of a batch that leaves a task.
HELD, BATCH = 1 << 24, 1 << 16
NAME, LISTS = 0, 1


def block_count(pairs: float, partitions: int) -> int:
    """Blocks for ``pairs`` unordered pairs."""
    tiles, n = max(min(LEAST_TILES, partitions), pairs / TILE_PAIRS), 1
    while n * (n + 1) / 2 < tiles:
        n += 1
    return n


def crossed(left: np.ndarray, ends: np.ndarray, right: np.ndarray, right_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (left, right) pairs of each row; ``ends`` are list offsets."""
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    own = left[ends[0]:ends[-1]]
    many = np.diff(right_ends)[row]
    first = np.cumsum(many) - many
    at = np.arange(many.sum()) + np.repeat(right_ends[:-1][row] - first, many)
    return np.repeat(own, many), right[at]


def within(left: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of two places of each row's list."""
    place = np.arange(ends[0], ends[-1])
    many = np.repeat(ends[1:], np.diff(ends)) - place - 1
    first = np.cumsum(many) - many
    at = np.arange(many.sum()) + np.repeat(place + 1 - first, many)
    return np.repeat(left[place], many), left[at]


def summed(parts: list[tuple[np.ndarray, np.ndarray | None]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """One part with every key once, in order; a part without counts counts ones."""
    keys = np.concatenate([k for k, _ in parts])
    if all(n is None for _, n in parts):
        keys.sort()
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        return [(keys[starts], np.diff(np.append(starts, len(keys))))]
    counts = np.concatenate([np.ones(len(k), np.int64) if n is None else n for k, n in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return [(keys[starts], np.add.reduceat(counts, starts))]


def _offsets(lists: pa.ListArray) -> np.ndarray:
    return lists.offsets.to_numpy().astype(np.int64)


def _counting(keys: Sequence[str]):
    def tile(names: list[pa.RecordBatch], lists: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(names).combine_chunks()
        ids = table.column("id").to_numpy()
        order = np.argsort(ids)
        ids, table, size = ids[order], table.take(order), len(ids)
        parts: list[tuple[np.ndarray, np.ndarray | None]] = []
        held = 0
        for batch in lists:
            for same in (True, False):
                own = batch.filter(pa.array(batch.column("same").to_numpy(zero_copy_only=False) == same))
                if not own.num_rows:
                    continue
                left, right = own.column("left_ids"), own.column("right_ids")
                a, ends = np.searchsorted(ids, left.values.to_numpy()), _offsets(left)
                b = a if same else np.searchsorted(ids, right.values.to_numpy())
                # a slice of rows at a time: few rows may hold many pairs
                width = np.diff(ends)
                pairs = width * (width - 1) // 2 if same else width * np.diff(_offsets(right))
                cuts = np.flatnonzero(np.diff(np.cumsum(pairs) // HELD)) + 1
                for lo, hi in zip([0, *cuts], [*cuts, own.num_rows]):
                    x, y = within(a, ends[lo:hi + 1]) if same else crossed(a, ends[lo:hi + 1], b, _offsets(right)[lo:hi + 1])
                    x, y = x[x != y], y[x != y]
                    parts.append((np.minimum(x, y) * size + np.maximum(x, y), None))
                    held += len(x)
                    if held >= HELD:
                        parts = summed(parts)
                        held = 0
        if not parts:
            return
        [(found, counts)] = summed(parts)
        for lo in range(0, len(found), BATCH):
            x, y = (pa.array(v) for v in np.divmod(found[lo:lo + BATCH], size))
            first, second = table.take(x), table.take(y)
            columns = [first.column(k) for k in (*keys, "item")] + [second.column("item"), pa.array(counts[lo:lo + BATCH]),
                                                                    first.column("n"), second.column("n")]
            yield from pa.Table.from_arrays(columns, [*keys, "a", "b", "co", "n_a", "n_b"]).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(batches)
        ahead = next(pieces, None)
        while ahead is not None:
            now, names = ahead[0], []
            while ahead is not None and ahead[:2] == (now, NAME):
                names.append(ahead[2])
                ahead = next(pieces, None)

            def lists() -> Iterator[pa.RecordBatch]:
                nonlocal ahead
                while ahead is not None and ahead[:2] == (now, LISTS):
                    yield ahead[2]
                    ahead = next(pieces, None)
            if names:
                yield from tile(names, lists())
            for _ in lists():
                pass
    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Runs of rows of one (tile, kind), rows being in that order."""
    for batch in batches:
        tiles, kinds = batch.column("tile").to_numpy(), batch.column("kind").to_numpy()
        starts = np.flatnonzero((np.diff(tiles) != 0) | (np.diff(kinds) != 0)) + 1
        for lo, hi in zip([0, *starts], [*starts, batch.num_rows]):
            if hi > lo:
                yield int(tiles[lo]), int(kinds[lo]), batch.slice(lo, hi - lo)


def pairs_of_lists(names: DataFrame, lists: DataFrame, pairs: DataFrame, keys: Sequence[str], blocks: int) -> DataFrame:
    """(keys, a, b, co, n_a, n_b) with a < b: how many of ``lists`` (``ids``: numbers) and of
    ``pairs`` (``left_ids``, ``right_ids``: one of each) hold both items.

    ``names`` has (keys, item, id, n) once for each number, in whose order items are."""
    spark, keys = names.sparkSession, list(keys)
    tiles = [(i, j) for i in range(blocks) for j in range(i, blocks)]
    number = {t: k for k, t in enumerate(tiles)}
    block, nothing = F.pmod(F.xxhash64("id"), F.lit(blocks)), F.lit(None).cast("array<bigint>")

    def dealt(column: str):
        return F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda g: F.filter(
            column, lambda x: F.pmod(F.xxhash64(x), F.lit(blocks)) == g))

    def places(of: list[tuple[int, int]]):
        return F.explode(F.array(*(F.struct(F.lit(number[min(t), max(t)]).alias("tile"), F.lit(t[0]).alias("i"), F.lit(t[1]).alias("j"))
                                   for t in of))).alias("_t")

    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in names.select(*keys, "item", "id", "n").schema.fields]
    home = F.explode(F.element_at(F.array(*(F.array(*(F.lit(number[min(g, h), max(g, h)]) for h in range(blocks)))
                                            for g in range(blocks))), block.cast("int") + 1)).alias("tile")
    named = names.select(home, F.lit(NAME).alias("kind"), F.lit(False).alias("same"), nothing.alias("left_ids"), nothing.alias("right_ids"),
                         *keys, "item", "id", "n")
    one = lists.select(dealt("ids").alias("_b")).select("_b", places(tiles)).select(
        "_t.tile", F.lit(LISTS).alias("kind"), (F.col("_t.i") == F.col("_t.j")).alias("same"), F.col("_b")[F.col("_t.i")].alias("left_ids"),
        F.when(F.col("_t.i") != F.col("_t.j"), F.col("_b")[F.col("_t.j")]).otherwise(F.array().cast("array<bigint>")).alias("right_ids"), *none)
    two = pairs.select(dealt("left_ids").alias("_b"), dealt("right_ids").alias("_o")).select(
        "_b", "_o", places([(i, j) for i in range(blocks) for j in range(blocks)])).select(
        "_t.tile", F.lit(LISTS).alias("kind"), F.lit(False).alias("same"), F.col("_b")[F.col("_t.i")].alias("left_ids"),
        F.col("_o")[F.col("_t.j")].alias("right_ids"), *none)
    some = F.when(F.col("same"), F.size("left_ids") > 1).otherwise((F.size("left_ids") > 0) & (F.size("right_ids") > 0))
    rows = named.unionByName(one.unionByName(two).where(some)).repartitionById(len(tiles), "tile").sortWithinPartitions("tile", "kind")
    types = {f.name: f.dataType.simpleString() for f in names.schema.fields}
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + [f"a {types['item']}, b {types['item']}, co bigint, n_a bigint, n_b bigint"])
    return rows.mapInArrow(_counting(keys), schema)
