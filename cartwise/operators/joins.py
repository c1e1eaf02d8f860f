"""Joins (inventory section 2.4) that are not part of a larger operator.

J5-J8 live in ``similarity``, J6 in ``rules``; J1-J3 are steps of the invoice
build in ``plans.dataset``; this module holds the generic ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise.scope import stored

SALTS = 16
#: Rows from which a key is hot, and the column in which a statistic may count them.
HOT, ROWS = 10_000, "_rows"


def salted_join(rows: DataFrame, stat: DataFrame, keys: Sequence[str],
                salts: int = SALTS) -> DataFrame:
    """Inner equi join of detail rows with one row per key.

    An aggregate joined back on its own key brings its partitioning along, and
    Spark's skew join does not split such a join.  Here rows of a hot key get a salt
    from a hash of all their columns and its statistic is repeated for every salt, so
    they go to ``salts`` places whatever the plan.  All other keys have salt 0 and one
    row of the statistic.  Hot keys have more than ``HOT`` rows, so their list holds at
    most a row for each ``HOT`` counted ones; they are counted in the column ``ROWS``
    of ``stat`` (which is dropped), else over ``rows``.  The statistic is read three
    times, so it is stored (one row per key): else all that it was made of would
    be built, and stand in the plan, three times more."""
    keys, stat = list(keys), stored(stat, "stat")
    counted = stat if ROWS in stat.columns else rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(ROWS))
    hot = F.broadcast(counted.where(F.col(ROWS) > HOT).select(*keys, F.lit(salts).alias("_salts")))
    salt = F.pmod(F.xxhash64(*rows.columns), F.col("_salts")).cast("int")
    dealt = rows.join(hot, keys, "left").withColumn("_salt", F.coalesce(salt, F.lit(0))).drop("_salts")
    return dealt.join(repeated(stat.drop(ROWS), hot, keys), [*keys, "_salt"]).drop("_salt")


def repeated(stat: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``stat`` with ``_salt``: a row for every salt of a hot key, one row for others."""
    last = F.coalesce(F.col("_salts") - 1, F.lit(0))
    return (stat.join(hot, list(keys), "left")
            .withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_salts"))


def with_group_stat(df: DataFrame, keys: Sequence[str], stat: Column, out: str) -> DataFrame:
    """Aggregate per group (combined before the shuffle) and join the value
    back onto every detail row; a hot group's rows are salted."""
    return salted_join(df, df.groupBy(*keys).agg(stat.alias(out), F.count(F.lit(1)).alias(ROWS)), keys)


def resolve_ids(reco: DataFrame, users: DataFrame, items: DataFrame,
                user_id: str = "customer_id", item_id: str = "product_id") -> DataFrame:
    """Numeric model ids back to customer and model numbers via the
    distinct id maps (two equi joins; AQE picks broadcast when they are small)."""
    return reco.join(users, user_id).join(items, item_id)
