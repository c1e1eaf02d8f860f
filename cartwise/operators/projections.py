"""Projections, renames and derived columns (inventory section 2.3)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise import config as C
from cartwise.operators.joins import ROWS, salted_join


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _label_map(mapping: Mapping[str, str]) -> Column:
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.create_map(*pairs)


def region_labels() -> dict[str, str]:
    lo, hi = int(C.REGION_CODE_LOW), int(C.REGION_CODE_HIGH)
    return {str(n).zfill(C.REGION_CODE_WIDTH): f"Region-{n}" for n in range(lo, hi + 1)}


def label_region(df: DataFrame, code_col: str = "sales_region", out: str = "region") -> DataFrame:
    """Region code -> 'Region-NN', any other code kept as is."""
    return df.withColumn(out, F.coalesce(F.element_at(_label_map(region_labels()),
                                                      F.col(code_col)), F.col(code_col)))


def label_area(df: DataFrame, code_col: str = "customerdivision",
               out: str = "customer_area") -> DataFrame:
    """Division code -> customer area name, any other code kept as is."""
    return df.withColumn(out, F.coalesce(F.element_at(_label_map(C.AREA_LABELS),
                                                      F.col(code_col)), F.col(code_col)))


def positional_rename(df: DataFrame, cols: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Select columns and rename them by position."""
    if len(cols) != len(names):
        raise ValueError("cols and names differ in length")
    return df.select(*cols).toDF(*names)


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """P4."""
    return df.withColumnsRenamed(dict(mapping))


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P5: drop listed columns (names trimmed; unknown names ignored)."""
    return df.drop(*[c.strip() for c in cols])


def raw_rating(df: DataFrame, value_col: str, base: str = "share",
               item_col: str = "model_number", keys: Sequence[str] = ("customer_area",),
               base_col: str = "avg_order") -> DataFrame:
    """P6/P7 with J4/A3/A4: raw_rating = value / item base, where the base is
    the item's total (``share``) or mean (``mean``) over customers.

    The per-item base is a partial (map-side combined) aggregate joined back on
    the item key; AQE broadcasts it when small, and the salted join deals the
    rows of a hot item over several tasks otherwise."""
    return over_base(with_base(df, value_col, base, item_col, keys, base_col), value_col, base_col)


def with_base(df: DataFrame, value_col: str, base: str = "share", item_col: str = "model_number",
              keys: Sequence[str] = ("customer_area",), base_col: str = "avg_order") -> DataFrame:
    """The join of ``raw_rating``: rows with their item's base."""
    group = [*keys, item_col]
    agg = F.sum(value_col) if base == "share" else F.avg(value_col)
    stat = df.groupBy(*group).agg(agg.alias(base_col), F.count(F.lit(1)).alias(ROWS)).where(F.col(base_col) != 0)
    return salted_join(df, stat, group)


def over_base(df: DataFrame, value_col: str, base_col: str) -> DataFrame:
    """The division of ``raw_rating``."""
    return df.withColumn("raw_rating", F.col(value_col) / F.col(base_col))


def cap(col, limit: float | None = None) -> Column:
    """Values above ``limit`` become ``limit`` (null stays null; no limit: as is)."""
    c = _c(col)
    if limit is None:
        return c
    return F.when(c > limit, F.lit(float(limit))).otherwise(c)


def purchased_flag() -> Column:
    """P9."""
    return F.lit(1)


def binarise(col) -> Column:
    """P10: 1 if x > 0 else 0."""
    return F.when(_c(col) > 0, F.lit(1)).otherwise(F.lit(0))


def cast_keys(df: DataFrame, cols: Sequence[str], to: str = "bigint") -> DataFrame:
    """Key casts; dirty keys become null instead of failing under ANSI."""
    return df.withColumns({c: F.col(c).try_cast(to) for c in cols})
