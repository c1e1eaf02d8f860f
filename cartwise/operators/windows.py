"""Windows, sorts and top-k (inventory section 2.6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartwise.operators.joins import ROWS, salted_join


def top_items(df: DataFrame, k: int, keys: Sequence[str], score: str, item: str,
              rank_col: str = "row") -> DataFrame:
    """The ``k`` best items per key by ``score`` desc, ties by item asc.

    Kept in the ``row_number() <= k`` shape so Catalyst plans a
    WindowGroupLimit: each map task keeps at most k rows per key before the
    shuffle, so a customer with a huge history never ships it whole."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(item))
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def ranked_list(df: DataFrame, keys: Sequence[str], item: str, rank_col: str,
                out: str) -> DataFrame:
    """A7 in rank order: one array per key, items ordered by ``rank_col``.
    Only used on top-k output, so each list is bounded by k."""
    return (df.groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct(F.col(rank_col).alias("r"),
                                                      F.col(item).alias("i")))).alias("_l"))
            .select(*keys, F.transform("_l", lambda x: x["i"]).alias(out)))


def baskets(df: DataFrame, keys: Sequence[str] = ("customernumber", "sales_receipt"),
            item: str = "model_number") -> DataFrame:
    """One sorted item set per (customer, receipt) with its size.
    A group-by (partial aggregation) instead of a window plus distinct."""
    return (df.where(F.col(item).isNotNull())
            .groupBy(*keys).agg(F.array_sort(F.collect_set(item)).alias(item))
            .withColumn("count", F.size(item)))


def scale_per_item(df: DataFrame, col: str, out: str, item: str = "model_number",
                   digits: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """(r - (min - 1)) / (max - (min - 1)) within each item, rounded.
    Per-item bounds are a partial aggregate joined back (a hot item's rows are
    salted), not an unbounded window over one item's rows."""
    stats = df.groupBy(*keys, item).agg(F.min(col).alias("_mn"), F.max(col).alias("_mx"),
                                          F.count(F.lit(1)).alias(ROWS))
    base = F.col("_mn") - 1
    return (salted_join(df, stats, [*keys, item])
            .withColumn(out, F.round((F.col(col) - base) / (F.col("_mx") - base), digits))
            .drop("_mn", "_mx"))


def head_items(col, n: int):
    """First ``n`` items of a rank-ordered array."""
    c = F.col(col) if isinstance(col, str) else col
    return F.slice(c, 1, n)
