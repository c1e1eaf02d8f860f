"""Filters and predicates (inventory section 2.2)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise import config as C
from cartwise.functions.text import not_blank


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def latest_month(df: DataFrame, month_col: str, pred: Column | None = None) -> DataFrame:
    """One-row frame holding the latest month having a row matching ``pred``."""
    src = df if pred is None else df.where(pred)
    return src.agg(F.max(month_col).alias("_latest_month"))


def in_month(df: DataFrame, latest: DataFrame, month_col: str) -> DataFrame:
    """Keep rows of the month held by the one-row ``latest`` frame.

    The scalar stays on the executors: the one-row aggregate is broadcast
    (size bound: exactly one row) into a semi join; no driver round trip."""
    return df.join(F.broadcast(latest), F.col(month_col) == F.col("_latest_month"), "left_semi")


def latest_snapshot(df: DataFrame, month_col: str, pred: Column | None = None) -> DataFrame:
    """keep rows of the latest month that has any row matching ``pred``."""
    return in_month(df, latest_month(df, month_col, pred), month_col)


def code_between(col, lo: str, hi: str) -> Column:
    """inclusive lexical range over zero-padded code strings."""
    return _c(col).between(F.lit(lo), F.lit(hi))


def active_customer_master(md: DataFrame) -> DataFrame:
    """F2 (master part): account group DEBI, not deleted, status 4."""
    return md.where(
        (F.col("customer_account_group") == C.CUSTOMER_ACCOUNT_GROUP)
        & (F.col("deletion_flag_for_customer_sales_level") != C.ACTIVE_FLAG)
        & (F.col("customer_status") == C.CUSTOMER_STATUS_ACTIVE))


def active_customer_predicate() -> Column:
    """the conjunction applied after the activity/master join."""
    return ((F.col("customer_account_group") == C.CUSTOMER_ACCOUNT_GROUP)
            & (F.col("active_customer_cr") == C.ACTIVE_FLAG)
            & (F.col("customer_status") == C.CUSTOMER_STATUS_ACTIVE)
            & code_between("sales_region", C.REGION_CODE_LOW, C.REGION_CODE_HIGH)
            & not_blank("customer")
            & (F.col("sales_channel") == C.SALES_CHANNEL))


def active_products(prod: DataFrame) -> DataFrame:
    """status 5, listed in the e-shop, current partition."""
    return prod.where((F.col("n_ac_status") == C.PRODUCT_STATUS_ACTIVE)
                      & (F.col("b_ac_is_in_eshop") == C.PRODUCT_IN_ESHOP)
                      & (F.col("partition_value") == C.PRODUCT_PARTITION))


def drop_null_keys(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """F6."""
    return df.na.drop(subset=list(subset))


def not_null(col) -> Column:
    """F7."""
    return _c(col).isNotNull()


def drop_negative(df: DataFrame, col: str) -> DataFrame:
    """F8: exclude returns (negative values); nulls fall out as well."""
    return df.where(F.col(col) >= 0)


def dropna_any(df: DataFrame) -> DataFrame:
    """F9."""
    return df.na.drop(how="any")


def trailing_months(df: DataFrame, day_col: str, as_of: str, months: int = C.TRAILING_MONTHS
                    ) -> DataFrame:
    """inclusive window [first of as_of's month - months, first of as_of's month].

    Bounds are folded to date literals so the predicate reaches the scan."""
    end = F.trunc(F.to_date(F.lit(as_of)), "MM")
    start = F.add_months(end, -months)
    return df.where(F.col(day_col).between(start, end))


def date_between(df: DataFrame, day_col: str, lo: str, hi: str) -> DataFrame:
    """fixed inclusive date range."""
    return df.where(F.col(day_col).between(F.to_date(F.lit(lo)), F.to_date(F.lit(hi))))


def for_area(df: DataFrame, area: str, area_col: str = "customer_area") -> DataFrame:
    """F12."""
    return df.where(F.col(area_col) == F.lit(area))


def exclude_families(df: DataFrame, excluded: Mapping[str, Sequence[str]],
                     area_col: str = "customer_area", family_col: str = "product_family"
                     ) -> DataFrame:
    """drop non-bundlable families per area (rows of such areas with a
    null family are dropped too, like NOT LIKE on null).  The exclusion list is
    a configuration literal, so it is an IN predicate, not a join."""
    cond = None
    for area, fams in excluded.items():
        hit = (F.col(area_col) == F.lit(area)) & (
            F.col(family_col).isNull() | F.col(family_col).isin(list(fams)))
        cond = hit if cond is None else (cond | hit)
    if cond is None:
        return df
    return df.where(~F.coalesce(cond, F.lit(False)))


def positive_only(df: DataFrame, col: str) -> DataFrame:
    """keep rows whose aggregate is > 0."""
    return df.where(F.col(col) > 0)


def cap_frequency(itemsets: DataFrame, max_freq: int) -> DataFrame:
    """drop itemsets above an absolute count (no default: it grows with the data)."""
    return itemsets.where(F.col("freq") <= max_freq)


def min_lift(rules: DataFrame, lift: float = C.MIN_LIFT) -> DataFrame:
    """F16."""
    return rules.where(F.col("lift") >= lift)


def split_matched(df: DataFrame, conf_col: str = "confidence") -> tuple[DataFrame, DataFrame]:
    """(matched: confidence > 0, unmatched: confidence = 0 or no rule)."""
    conf = F.coalesce(F.col(conf_col), F.lit(0.0))
    return df.where(conf > 0), df.where(conf == 0)


def min_active_months(df: DataFrame, n: int = C.NCF_MIN_MONTHS,
                      cust_col: str = "customernumber") -> DataFrame:
    """customers with more than ``n`` distinct purchase year-months."""
    from cartwise.functions.dates import year_month_key
    months = (df.select(cust_col, year_month_key("sales_year", "sales_month").alias("_ym"))
              .groupBy(cust_col).agg(F.countDistinct("_ym").alias("_months"))
              .where(F.col("_months") > n).select(cust_col))
    return df.join(months, cust_col, "left_semi")


def min_distinct_items(df: DataFrame, n: int = C.NCF_MIN_ITEMS,
                       cust_col: str = "customernumber", item_col: str = "model_number"
                       ) -> DataFrame:
    """customers with more than ``n`` distinct items."""
    items = (df.groupBy(cust_col).agg(F.countDistinct(item_col).alias("_items"))
             .where(F.col("_items") > n).select(cust_col))
    return df.join(items, cust_col, "left_semi")


def expect_reduced(before: DataFrame, after: DataFrame) -> DataFrame:
    """one row (before_rows, after_rows, reduced) computed in one job."""
    tagged = (before.select(F.lit(1).alias("_b"), F.lit(0).alias("_a"))
              .unionByName(after.select(F.lit(0).alias("_b"), F.lit(1).alias("_a"))))
    out = tagged.agg(F.sum("_b").cast("bigint").alias("before_rows"),
                     F.sum("_a").cast("bigint").alias("after_rows"))
    return out.select("before_rows", "after_rows",
                      (F.col("after_rows") < F.col("before_rows")).alias("reduced"))


def in_box(df: DataFrame, x0: float, x1: float, y0: float, y1: float,
           x: str = "x", y: str = "y") -> DataFrame:
    """points inside a rectangle (bounds in either order)."""
    return df.where(F.col(x).between(min(x0, x1), max(x0, x1))
                    & F.col(y).between(min(y0, y1), max(y0, y1)))


def by_source(df: DataFrame, source: str | int = "all", col: str = "source") -> DataFrame:
    """points of one method, or all."""
    if source == "all":
        return df
    return df.where(F.col(col) == F.lit(source))


def select_nodes(nodes: DataFrame, edges: DataFrame, item: str, prop: str,
                 values: Sequence) -> DataFrame:
    """node ids chosen by a node property, or the endpoints of edges
    whose property is in ``values``."""
    if item == "node":
        return nodes.where(F.col(prop).isin(list(values))).select(F.col("id")).distinct()
    hit = edges.where(F.col(prop).isin(list(values)))
    return (hit.select(F.col("from").alias("id"))
            .union(hit.select(F.col("to").alias("id"))).distinct())


def subgraph_nodes(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """keep the chosen nodes only."""
    return nodes.join(ids, "id", "left_semi")
