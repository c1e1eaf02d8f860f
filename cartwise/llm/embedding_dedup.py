"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Equal vectors become one class.  A rotation to principal axes (from the second
moments of all unit vectors) puts most of each product into the leading
dimensions.  Classes are cut into blocks along the first axis; tasks compare pairs
of blocks tile by tile.  For a pair of tiles the leading dimensions are multiplied
first; the norms of the rest bound what can be added, and a pair that cannot
reach the threshold is left there.  Pairs that remain after some steps are decided
by the cosine of the original vectors in double precision.  Tiles whose boxes are
too far apart are skipped whole.

A task returns link counts and a spanning forest of its links, never the links
themselves.  Where vectors do not gather along their axes, all blocks meet all
others: the work is then quadratic in the number of different vectors, though each
task's memory is that of two blocks."""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise.llm.common import batch_rows, components, materialize

BLOCK_ROWS, TILE_ROWS = 8_192, 1_024
#: Links that a task holds before it reduces them to a forest.
HELD_LINKS = 1 << 20
#: What screening in single precision may be wrong by.
SLACK = 1e-4
BLOCK = "block long, ids binary, sizes binary, widths binary, vectors binary"


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and all components finite."""
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0)
                      & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
                      & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled before squaring, so that none overflows."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def padded(column: pa.Array, width: int) -> np.ndarray:
    """List rows as a matrix, shorter ones filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _moments(width: int):
    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            if len(batch):
                u = unit(padded(batch.column("vector"), width))
                total += u.T @ u
        yield pa.RecordBatch.from_pydict({"part": [0], "moments": [total.tobytes()]})
    return run


def principal_axes(classes: DataFrame, width: int) -> np.ndarray:
    """Columns: axes in order of falling second moment over all classes."""
    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in rows["moments"])
        return pd.DataFrame({"moments": [total.tobytes()]})
    parts = (classes.select("vector").mapInArrow(_moments(width), "part long, moments binary")
             .withColumn("part", F.pmod(F.spark_partition_id(), F.lit(16))))
    rows = parts.groupBy("part").applyInPandas(add, "moments binary").collect()
    total = sum((np.frombuffer(r["moments"]).reshape(width, width) for r in rows), np.zeros((width, width)))
    return np.linalg.eigh(total)[1][:, ::-1]


def _first_axis(axis: np.ndarray):
    def run(batches):
        for batch in batches:
            place = unit(padded(batch.column("vector"), len(axis))) @ axis if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], [*batch.schema.names, "place"])
    return run


def _pack(width: int):
    def pack(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "first"])
        vectors = np.zeros((len(rows), width), np.float64)
        for k, v in enumerate(rows["vector"]):
            vectors[k, :len(v)] = v
        return pd.DataFrame({"block": [key[0]], "ids": [rows["first"].to_numpy(np.int64).tobytes()],
                             "sizes": [rows["n"].to_numpy(np.int64).tobytes()],
                             "widths": [rows["vector"].map(len).to_numpy(np.int64).tobytes()],
                             "vectors": [vectors.tobytes()]})
    return pack


class Side:
    """One block of a pair, rotated, with norms of what follows each step."""

    def __init__(self, row: dict, side: str, axes: np.ndarray, steps: list[int]):
        self.ids, self.sizes, self.widths = (np.frombuffer(row[f"{c}_{side}"], np.int64) for c in ("ids", "sizes", "widths"))
        self.vectors = np.frombuffer(row[f"vectors_{side}"]).reshape(len(self.ids), -1)
        self.unit = unit(self.vectors)
        self.turned = self.unit @ axes
        rest = np.sqrt(np.maximum(0, 1 - np.cumsum(self.turned ** 2, axis=1)))
        self.steps = [np.column_stack([self.turned[:, a:b], rest[:, b - 1]]).astype(np.float32)
                      for a, b in zip([0, *steps], steps)]
        self.tiles = [slice(a, a + TILE_ROWS) for a in range(0, len(self.ids), TILE_ROWS)]
        self.low = [self.turned[t].min(axis=0) for t in self.tiles]
        self.high = [self.turned[t].max(axis=0) for t in self.tiles]


def tile_links(x: Side, y: Side, a: slice, b: slice, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of two tiles whose cosine is at least ``least``."""
    lead = x.steps[0][a] @ y.steps[0][b].T  # the last column adds the product of the rest norms
    r, c = np.nonzero(lead >= least - SLACK)
    found = []
    for at in range(0, len(r), 1 << 16):
        i, j = r[at:at + (1 << 16)] + a.start, c[at:at + (1 << 16)] + b.start
        so_far = lead[i - a.start, j - b.start] - x.steps[0][i, -1] * y.steps[0][j, -1]
        for s, t in zip(x.steps[1:], y.steps[1:]):
            so_far = so_far + np.einsum("ij,ij->i", s[i, :-1], t[j, :-1])
            on = so_far + s[i, -1] * t[j, -1] >= least - SLACK
            i, j, so_far = i[on], j[on], so_far[on]
        cosine = np.einsum("ij,ij->i", x.unit[i], y.unit[j])
        on = (cosine >= least) & (x.widths[i] == y.widths[j])
        found.append((i[on], j[on]))
    return tuple(np.concatenate(z) if found else np.zeros(0, np.int64) for z in (zip(*found) if found else ((), ())))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but the roots with the smallest node that it is connected to."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[:len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        for end in (a, b):
            np.minimum.at(label, label[end], low)
            np.minimum.at(label, end, low)
        label = label[label]
        if (label == before).all():
            break
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def _compare(axes, least: float):
    def run(batches):
        turn = axes.value
        width = len(turn)
        steps = sorted({max(1, width // 4), max(1, width // 2), width})
        for batch in batches:
            for row in batch.to_pylist():
                x, y = (Side(row, s, turn, steps) for s in "xy")
                same = row["block_x"] == row["block_y"]
                n_x, n_y = np.zeros(len(x.ids), np.int64), np.zeros(len(y.ids), np.int64)
                ends: list = [[], []]
                for k, a in enumerate(x.tiles):
                    for m, b in enumerate(y.tiles):
                        if same and m < k:
                            continue
                        gap = np.maximum(0, np.maximum(x.low[k] - y.high[m], y.low[m] - x.high[k]))
                        if gap @ gap > 2 - 2 * least + SLACK:
                            continue
                        i, j = tile_links(x, y, a, b, least)
                        if same and m == k:
                            i, j = i[i < j], j[i < j]
                        np.add.at(n_x, i, y.sizes[j])
                        np.add.at(n_y, j, x.sizes[i])
                        ends[0].append(x.ids[i])
                        ends[1].append(y.ids[j])
                        if sum(map(len, ends[0])) > HELD_LINKS:
                            ends = [[z] for z in forest(*map(np.concatenate, ends))]
                a, b = forest(*map(np.concatenate, ends)) if ends[0] else (x.ids[:0], x.ids[:0])
                ids, n = np.concatenate([x.ids, y.ids]), np.concatenate([n_x, n_y])
                ids, n = ids[n > 0], n[n > 0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([ids, a])), pa.array([None] * len(ids) + b.tolist(), pa.int64()),
                     pa.array(np.concatenate([n, np.zeros(len(a), np.int64)]))], ["a", "b", "n"])
    return run


def near_duplicates(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """Link ``vectors(vec_id, embedding, ...)`` whose cosine is at least ``least``.

    Returns one row per row: vec_id, n_links (other rows linked directly),
    component_id (smallest vec_id reachable, itself included), kept (vec_id =
    component_id).  Vectors that are null, empty, zero, or hold null or
    non-finite components link with nothing, nor do vectors of different length
    or rows with a null vec_id (their component is null and they are not kept).
    Repeated rows link with each other; rows that share a vec_id are vectors of their
    own.  Other columns are left out.  An empty
    table gives an empty table.  ``least`` must be above 0."""
    spark = vectors.sparkSession
    vector = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", F.when(usable(vector) & F.col("vec_id").isNotNull(), vector).alias("vector"))
    rows = rows.select("vec_id", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.reverse("vector"), F.size("vector")).alias("h2"))
    classes = materialize(rows.where("vector is not null").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector"))
        .withColumn("first", F.monotonically_increasing_id()), "vector-classes")  # a class's number, whatever ids its rows share
    n, width = classes.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if not n:
        alone = F.col("vec_id").alias("component_id")
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), alone, F.col("vec_id").isNotNull().alias("kept"))
    axes = principal_axes(classes, width)
    cuts = -(-n // BLOCK_ROWS)
    placed = materialize(classes.select("first", "n", "vector").mapInArrow(
        _first_axis(axes[:, 0]), "first long, n long, vector array<double>, place double"), "vectors-placed")
    bounds = placed.agg(F.percentile_approx("place", [k / cuts for k in range(1, cuts)] or [0.5], 10 * cuts + 1000)).first()[0]
    strip = F.size(F.filter(F.lit(bounds[:cuts - 1]) if cuts > 1 else F.array().cast("array<double>"),
                            lambda x: x < F.col("place")))
    placed = placed.withColumn("strip", strip.cast("long"))
    parts = placed.groupBy("strip").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("parts"))
    blocks = materialize(placed.join(parts, "strip").withColumn(
        "block", F.col("strip") * (1 << 20) + F.pmod(F.xxhash64("first"), F.col("parts")))
        .groupBy("block").applyInPandas(_pack(width), BLOCK), "vector-blocks")
    names = sorted(r["block"] for r in blocks.select("block").collect())
    ranks = spark.createDataFrame(list(enumerate(names)) or [], "rank long, block long")
    ranked = blocks.join(ranks, "block")  # a row for each BLOCK_ROWS classes
    pairs = ranks.select(F.col("rank").alias("rank_x"), F.explode(F.sequence("rank", F.lit(len(names) - 1))).alias("rank_y"))
    for s in "xy":
        pairs = pairs.join(ranked.select(*(F.col(c).alias(f"{c}_{s}") for c in ranked.columns)), f"rank_{s}")
    shared = spark.sparkContext.broadcast(axes)
    tasks = min(len(names) * (len(names) + 1) // 2, 10_000)
    with batch_rows(spark, 1):
        found = materialize(pairs.repartition(tasks, "block_x", "block_y").mapInArrow(
            _compare(shared, least), "a long, b long, n long"), "vector-links")
    counts = found.where("b is null").groupBy(F.col("a").alias("first")).agg(F.sum("n").alias("links"))
    edges = found.where("b is not null").select("a", "b")
    parents = components(classes.select(F.col("first").alias("node")), edges, "vector")
    told = materialize(classes.select("h1", "h2", "least", "first", "n").join(counts, "first", "left")
                       .join(parents.withColumnRenamed("node", "first"), "first"), "vector-parents")
    smallest = materialize(told.groupBy("component").agg(F.min("least").alias("__least")), "vector-least")
    told = materialize(told.join(smallest, "component").select(
        "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.col("__least").alias("component")), "vector-told")
    mine = F.col("vector").isNotNull()
    return (rows.join(told, ["h1", "h2"], "left").select(
        "vec_id", F.when(mine, F.col("n_links")).otherwise(0).cast("long").alias("n_links"),
        F.when(mine, F.col("component")).otherwise(F.col("vec_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))


def brute_force(rows: list[tuple[int, list | None]], least: float = 0.9) -> dict[int, tuple]:
    """The same result by plain loops, for tests (different vec_ids)."""
    good = {i: v for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    component = {i: i for i, _ in rows}
    n = dict.fromkeys(component, 0)

    def root(i):
        while component[i] != i:
            i = component[i]
        return i
    ids = sorted(good)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if len(good[i]) == len(good[j]):
                a, b = np.array(good[i], float), np.array(good[j], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                    n[i] += 1
                    n[j] += 1
                    x, y = sorted((root(i), root(j)))
                    component[y] = x
    return {i: (n[i], root(i), root(i) == i) for i in component}
