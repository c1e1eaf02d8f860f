"""String functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartwise import config as C


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def name_prefix(col, sep: str = ":") -> Column:
    """Text before the first ``sep``; the whole text when absent."""
    return F.substring_index(_c(col), sep, 1)


def trim_text(col) -> Column:
    """X2."""
    return F.trim(_c(col))


def not_blank(col) -> Column:
    """``trim(col) != ''``; null is not kept either (3-valued logic)."""
    return F.trim(_c(col)) != F.lit("")


def like(col, pattern: str, negate: bool = False) -> Column:
    """SQL LIKE / NOT LIKE."""
    c = _c(col).like(pattern)
    return ~c if negate else c


def rule_text(antecedent, consequent, sep: str = ",") -> Column:
    """Comma-joined antecedent followed by consequent."""
    return F.concat_ws(sep, _c(antecedent), _c(consequent))


def list_text(arr, sep: str = ", ") -> Column:
    """Array -> text joined with ', '."""
    return F.array_join(_c(arr), sep)


def describe_bundle(antecedent, consequent, bundle) -> Column:
    """The sentence shown for one bundle recommendation."""
    a, b, c = (list_text(x) for x in (antecedent, consequent, bundle))
    head, rest = C.DESCRIPTION_TEMPLATE.split("{a}")
    mid, tail = rest.split("{b}")
    mid2, end = tail.split("{c}")
    return F.concat(F.lit(head), a, F.lit(mid), b, F.lit(mid2), c, F.lit(end))


def truncate_label(col, width: int = C.LABEL_WIDTH) -> Column:
    """First ``width`` characters plus '...' when longer."""
    c = _c(col)
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit("..."))
                  ).otherwise(c)


def parse_list_text(col) -> Column:
    """X9: "['a', 'b']" -> array('a', 'b') (quote and bracket characters removed)."""
    return F.split(F.translate(_c(col), "'[]", ""), ", ")


def split_text(col, sep: str = ",") -> Column:
    """X10."""
    return F.split(_c(col), sep)
