"""Feature scaling and indexing (inventory section 2.8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise.scope import stored


def minmax(df: DataFrame, col: str, out: str, lo: float = 0.0, hi: float = 1.0,
           by: Sequence[str] = ()) -> DataFrame:
    """M1: min-max rescale of ``col`` to [lo, hi] within each ``by`` group
    (the whole frame when empty).  A constant group maps to the midpoint,
    like ``MinMaxScaler``.  Group bounds are a partial aggregate joined back by a
    broadcast: one row per group, and ``by`` names few groups (the areas).  AQE would
    change the join only after all rows of a group had gone to one task, where the
    windows that follow would keep them."""
    stats = df.groupBy(*by).agg(F.min(col).alias("_emin"), F.max(col).alias("_emax"))
    joined = df.join(F.broadcast(stats), list(by)) if by else join_scalar(df, stats)
    scaled = F.when(F.col("_emax") == F.col("_emin"), F.lit(0.5 * (hi + lo))).otherwise(
        (F.col(col) - F.col("_emin")) / (F.col("_emax") - F.col("_emin")) * (hi - lo) + lo)
    return joined.withColumn(out, scaled).drop("_emin", "_emax")


def standardise(df: DataFrame, col: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """M2: divide by the sample standard deviation, no centring (0 when std is 0),
    as ``StandardScaler(withMean=False, withStd=True)``.  Joined as in ``minmax``."""
    stats = df.groupBy(*by).agg(F.stddev_samp(col).alias("_std"))
    joined = df.join(F.broadcast(stats), list(by)) if by else join_scalar(df, stats)
    return (joined.withColumn(out, F.when(F.col("_std") == 0, F.lit(0.0))
                              .otherwise(F.col(col) / F.col("_std")))
            .drop("_std"))


def dense_index(df: DataFrame, col: str, out: str) -> DataFrame:
    """M3: map each distinct value of ``col`` to 0..n-1 by descending frequency,
    ties by value ascending (``StringIndexer`` frequencyDesc order), joined back
    as a double.  Distributed: a range-partitioned sort, per-partition counts
    and prefix offsets, stored; no label list passes through the driver.  Nulls get the
    extra bucket n ('keep' for invalid labels)."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("_cnt"))
    ordered = (counts.orderBy(F.desc("_cnt"), F.asc(col))
               .withColumn("_pid", F.spark_partition_id())
               .withColumn("_mid", F.monotonically_increasing_id()))
    ordered = stored(ordered, "index")
    sizes = ordered.groupBy("_pid").agg(F.count("*").alias("_n"))
    offsets = sizes.select(
        "_pid",
        (F.sum("_n").over(_unbounded_by("_pid")) - F.col("_n")).alias("_off"))
    total = sizes.agg(F.sum("_n").alias("_total"))
    index = (ordered.join(F.broadcast(offsets), "_pid")
             .select(F.col(col), (F.col("_off") + F.col("_mid")
                                  - F.shiftleft(F.col("_pid").cast("bigint"), 33)
                                  ).cast("double").alias(out)))
    res = df.join(index, col, "left")
    return (join_scalar(res, total)
            .withColumn(out, F.coalesce(F.col(out), F.col("_total").cast("double")))
            .drop("_total"))


def ordered_numbers(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Number distinct rows 0..n-1 in ascending order of ``order``: a range-partitioned
    sort, per-partition counts and prefix offsets."""
    rows = (df.orderBy(*order).withColumn("_pid", F.spark_partition_id())
            .withColumn("_mid", F.monotonically_increasing_id()))
    rows = stored(rows, "numbers")
    sizes = rows.groupBy("_pid").agg(F.count("*").alias("_n_rows"))
    offsets = sizes.select("_pid", (F.sum("_n_rows").over(_unbounded_by("_pid")) - F.col("_n_rows")).alias("_off"))
    number = F.col("_off") + F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    return rows.join(F.broadcast(offsets), "_pid").withColumn(out, number).drop("_pid", "_mid", "_off")


def join_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row: an equi join on a
    constant key against a broadcast side whose size is exactly one row."""
    return (df.withColumn("_one", F.lit(1))
            .join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one")
            .drop("_one"))


def _unbounded_by(order_col: str):
    from pyspark.sql import Window
    # Running sum over the per-partition size table (one row per partition).
    return Window.orderBy(order_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def to_vector(df: DataFrame, col: str, out: str) -> DataFrame:
    """M4: double -> one-element ML vector."""
    return VectorAssembler(inputCols=[col], outputCol=out).transform(df)


def from_vector(col) -> Column:
    """M4: first element of an ML vector, JVM side (no Python UDF)."""
    c = F.col(col) if isinstance(col, str) else col
    return vector_to_array(c)[0]
