"""Array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def sorted_set(col) -> Column:
    """Sorted distinct elements."""
    return F.array_sort(F.array_distinct(_c(col)))


def concat_arrays(a, b) -> Column:
    """X15."""
    return F.concat(_c(a), _c(b))


def unique(col) -> Column:
    """Order-keeping distinct."""
    return F.array_distinct(_c(col))


def first_item(col) -> Column:
    """First element (null on empty)."""
    return F.get(_c(col), 0)


def slice_head(col, n: int) -> Column:
    """First ``n`` elements."""
    return F.slice(_c(col), 1, n)


def jaccard(a, b) -> Column:
    """|a & b| / |a | b| of two arrays (0 when both are empty)."""
    inter = F.size(F.array_intersect(_c(a), _c(b)))
    union = F.size(F.array_union(_c(a), _c(b)))
    return F.when(union == 0, F.lit(0.0)).otherwise(inter / union)
