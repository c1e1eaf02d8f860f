"""Aggregations, distinct and set operations (inventory section 2.5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUST = "customernumber"
ITEM = "model_number"


def customer_item_qty(df: DataFrame, keys: Sequence[str] = (CUST, ITEM),
                      qty: str = "soldnumber", out: str = "product_orders") -> DataFrame:
    """A1: quantity per (customer, item)."""
    return df.groupBy(*keys).agg(F.sum(qty).alias(out))


def customer_item_value(df: DataFrame, keys: Sequence[str] = (CUST, ITEM),
                        value: str = "sales_value", out: str = "turnover") -> DataFrame:
    """A2: turnover per (customer, item), summed as it is; whoever shows it rounds it."""
    return df.groupBy(*keys).agg(F.sum(value).alias(out))


def item_total(df: DataFrame, keys: Sequence[str] = (ITEM,), col: str = "product_orders",
               out: str = "avg_order") -> DataFrame:
    """A3: total over customers per item (named avg_order by the original)."""
    return df.groupBy(*keys).agg(F.sum(col).alias(out))


def item_mean(df: DataFrame, keys: Sequence[str] = (ITEM,), col: str = "turnover",
              out: str = "avg_turnover") -> DataFrame:
    """A4: mean over customers per item."""
    return df.groupBy(*keys).agg(F.avg(col).alias(out))


def active_months(df: DataFrame, cust: str = CUST, out: str = "active_months") -> DataFrame:
    """A5: distinct year-months per customer."""
    from cartwise.functions.dates import year_month_key
    return (df.groupBy(cust)
            .agg(F.countDistinct(year_month_key("sales_year", "sales_month")).alias(out)))


def distinct_items(df: DataFrame, cust: str = CUST, item: str = ITEM,
                   out: str = "distinct_items") -> DataFrame:
    """Number of distinct items per customer (no set is materialised)."""
    return df.groupBy(cust).agg(F.countDistinct(item).alias(out))


def item_sets(df: DataFrame, cust: str = CUST, item: str = ITEM,
              out: str = "actual_products") -> DataFrame:
    """Sorted set of items per customer (use on top-k output only)."""
    return df.groupBy(cust).agg(F.array_sort(F.collect_set(item)).alias(out))


def interaction_matrix(df: DataFrame, cust: str = CUST, item: str = ITEM,
                       value: str = "interaction", out: str = "bought") -> DataFrame:
    """Sparse customer x item matrix in long form: summed value,
    binarised (missing cells are implicit zeros and never materialised)."""
    return (df.groupBy(cust, item).agg(F.sum(value).alias("_v"))
            .select(cust, item, F.when(F.col("_v") > 0, 1).otherwise(0).alias(out)))


def value_range(df: DataFrame, key: str = "layer", col: str = "Value") -> DataFrame:
    """Numeric min and max per weight matrix."""
    return df.groupBy(key).agg(F.min(col).alias("min_value"), F.max(col).alias("max_value"))


def node_degree(edges: DataFrame, src: str = "from", dst: str = "to") -> DataFrame:
    """Number of distinct neighbours of each node (undirected)."""
    both = (edges.select(F.col(src).alias("id"), F.col(dst).alias("nb"))
            .union(edges.select(F.col(dst).alias("id"), F.col(src).alias("nb"))))
    return (both.where(F.col("id") != F.col("nb"))
            .groupBy("id").agg(F.countDistinct("nb").alias("value")))


def union_results(*frames: DataFrame) -> DataFrame:
    """Bag union by column name (UNION ALL)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
