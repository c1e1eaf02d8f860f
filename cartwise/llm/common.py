"""Spark helpers shared by the operators: scratch tables in the shared folder,
gapless ranks, and connected components."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartwise.session import ensure_checkpoint_dir

#: Rows that one Arrow batch holds; long documents make small batches necessary.
BATCH_ROWS = 512

_written: list[str] = []


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to a new table in the folder that driver and executors share
    (``spark.checkpoint.dir``) and read it back.

    This cuts the lineage: a lost executor costs no recomputation of it.  The
    table is there until ``clear_scratch``."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the tables that ``materialize`` has written in this process.  Call it
    when results have been read or written elsewhere."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches at ``BATCH_ROWS`` rows, so that a batch of very long
    documents stays within a Python worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts (one aggregate row)."""
    return docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0


def gapless(df: DataFrame, by: list[str], order: list[Column], spread: Column,
            buckets: int, out: str) -> DataFrame:
    """Number the rows of each ``by`` group from 0 without gaps.

    A group may hold any share of the rows: rows are ranked within (group,
    bucket), and each bucket starts where the sizes of the buckets before it
    end.  ``spread`` is a hash that deals rows over ``buckets``; ``order`` must
    be a total order within a bucket."""
    b, n, start = f"__{out}_b", f"__{out}_n", f"__{out}_s"
    df = df.withColumn(b, F.pmod(spread, F.lit(buckets)).cast("int"))
    sizes = df.groupBy(*by, b).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*by).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*by, b, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    rank = F.row_number().over(Window.partitionBy(*by, b).orderBy(*order))
    ranked = df.withColumn(out, rank.cast("long") - 1)
    return (ranked.join(starts, [*by, b]).withColumn(out, F.col(out) + F.col(start))
            .drop(b, start))


def components(nodes: DataFrame, edges: DataFrame, tag: str, max_rounds: int = 60) -> DataFrame:
    """Connected components: ``nodes(node)`` and undirected ``edges(a, b)`` give
    ``(node, component)`` with the smallest node of each component.

    Hooking and shortcutting (FastSV): per round every edge offers its end's
    label to the other end and to that end's label; then labels jump to their
    label's label.  Only ``min`` aggregates and equi-joins of stored tables are
    used, so a hub is combined before the shuffle or split by the skew join.
    Labels are written to the shared folder each round; only a count of changed
    labels reaches the driver."""
    touched = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
                       f"{tag}-edges")
    labels = materialize(touched.withColumn("component", F.col("node")), f"{tag}-labels")
    for _ in range(max_rounds):
        at = labels.select(F.col("node").alias("a"), F.col("component").alias("la"))
        to = labels.select(F.col("node").alias("b"), F.col("component").alias("lb"))
        offers = both.join(at, "a").join(to, "b").where("la < lb")
        best = (offers.select(F.explode(F.array("b", "lb")).alias("node"), "la")
                .groupBy("node").agg(F.min("la").alias("offer")))
        hooked = materialize(labels.join(best, "node", "left").select(
            "node", F.least("component", F.coalesce("offer", "component")).alias("component"),
            F.col("offer").isNotNull().cast("int").alias("moved")), f"{tag}-hooked")
        if not hooked.agg(F.max("moved")).first()[0]:
            labels = hooked.select("node", "component")
            break
        up = hooked.select(F.col("node").alias("component"), F.col("component").alias("above"))
        labels = materialize(hooked.select("node", "component").join(up, "component")
                             .select("node", F.col("above").alias("component")), f"{tag}-labels")
    else:
        raise RuntimeError("components did not converge")
    return nodes.join(labels, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"))


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Arrow batches of ``rows`` rows for the tables written inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def batch_bytes(spark: SparkSession, size: int):
    """Arrow batches of at most ``size`` bytes (and ``BATCH_ROWS`` rows, unless one
    row is larger) for the tables written inside; the settings before hold again
    afterwards."""
    settings = {"spark.sql.execution.arrow.maxBytesPerBatch": str(size),
                "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS)}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
