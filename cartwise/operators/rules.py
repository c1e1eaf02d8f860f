"""Frequent itemsets, association rules and rule matching (sections 2.9, J6, W5).

Mining counts sets of up to three items and grows larger ones by Spark ML's
parallel FP-growth.  Rules are derived from the
(optionally frequency-capped) itemsets with joins, so the frequency cap and
per-area support thresholds are exact.  Areas of about the same size share a fit
(items are tagged with their area); every area keeps its own minimum count.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwise import config as C
from cartwise.operators import itemsets as IS
from cartwise.scope import persist, stored

TAG_SEP = "\u001f"  # separates the area tag from the item inside one fit


def grown_itemsets(baskets: DataFrame, min_support: float, items: str = "items",
                   num_partitions: int | None = None) -> DataFrame:
    """Itemsets of all sizes by Spark ML's FP-growth."""
    fp = FPGrowth(itemsCol=items, minSupport=min_support, minConfidence=1.0)
    if num_partitions:
        fp = fp.setNumPartitions(num_partitions)
    return fp.fit(baskets.select(items)).freqItemsets.select(F.array_sort("items").alias("items"), "freq")


#: Sets of two or three are listed while they are at most ``SETS_PER_ITEM`` to a basket
#: item on average and ``SETS_PER_BASKET`` in any basket, and frequent ones are held by
#: the tasks up to ``LISTED``; FP-growth takes over at the first size beyond that.
SETS_PER_ITEM, SETS_PER_BASKET, LISTED = 64, 5_000_000, 1_000_000


def frequent_itemsets(baskets: DataFrame, min_support: float = C.MIN_SUPPORT,
                      items: str = "items", num_partitions: int | None = None) -> DataFrame:
    """Frequent itemsets (items sorted ascending, freq).

    Sets of one, two and three items are counted as they stand in the baskets.
    Larger ones come from FP-growth over what can still hold one: an item of a
    basket stays if enough frequent sets of the size before hold it there.  Where
    no set of three is frequent, no tree is grown.  The number of frequent sets is
    bounded by a basket's mean number of sets over ``min_support``, not by the rows."""
    rows = baskets.select(F.col(items).alias("items")).where(F.col("items").isNotNull())
    of, size = rows.schema["items"].dataType.elementType, F.size("items").cast("double")
    two, three = size * (size - 1) / 2, size * (size - 1) * (size - 2) / 6
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("held"),
                    F.max((F.size(F.array_distinct("items")) < F.size("items")).cast("int")).alias("twice"),
                    F.sum(two).alias("all2"), F.max(two).alias("most2"),
                    F.sum(three).alias("all3"), F.max(three).alias("most3")).first()
    if seen.twice:
        raise ValueError("items of a basket must be unique")
    least = math.ceil(min_support * seen.n)
    sizes = [k for k, total, most in ((2, seen.all2, seen.most2), (3, seen.all3, seen.most3))
             if total and total <= SETS_PER_ITEM * seen.held and most <= SETS_PER_BASKET]

    def often(counted: DataFrame) -> DataFrame:
        return persist(counted.where(F.col("freq") >= least))

    singles = often(rows.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("freq")))
    if singles.count() > LISTED:
        return grown_itemsets(rows, min_support, "items", num_partitions)
    found = [singles.select(F.array("item").alias("items"), "freq")]
    values = singles.select("item").orderBy("item").toArrow().column(0).combine_chunks()
    done, known, pairs = 1, None, None
    for k in sizes:
        if k != done + 1 or not len(values):
            break
        counted = often(rows.mapInArrow(IS.counter(values, k, pairs), "key long, freq long")
                        .groupBy("key").agg(F.sum("freq").alias("freq")))
        n_sets = counted.count()
        if n_sets > LISTED:
            break
        known = counted.select("key").orderBy("key").toArrow().column(0).combine_chunks().to_numpy(zero_copy_only=False)
        pairs, done = (known if k == 2 else pairs), k
        found.append(counted.mapInArrow(IS.decoder(values, k), T.StructType([
            T.StructField("items", T.ArrayType(of)), T.StructField("freq", T.LongType())])))
        if not n_sets:
            return reduce(DataFrame.unionAll, found[:-1])
    rest = persist(rows.mapInArrow(IS.trimmer(values, done, known, pairs),
                                   T.StructType([T.StructField("items", T.ArrayType(of))])))
    left = rest.count()
    if left and left >= least:
        grown = grown_itemsets(rest, max(least - 0.5, 0.0) / left, "items", num_partitions)
        found.append(grown.where(F.size("items") > done))
    return reduce(DataFrame.unionAll, found).select(F.array_sort("items").alias("items"), "freq")


def derive_rules(itemsets: DataFrame, n_baskets: DataFrame,
                 min_confidence: float = C.MIN_CONFIDENCE, min_lift: float | None = C.MIN_LIFT,
                 max_freq: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Single-consequent rules X\\{c} -> {c} of every itemset X.

    confidence = freq(X) / freq(X\\{c}); lift = confidence / support(c);
    support = freq(X) / n.  With ``max_freq`` (F15) only itemsets with
    freq <= max_freq serve as rule body or antecedent; the consequent support
    still uses the uncapped single-item counts.  ``n_baskets`` holds the
    basket count per ``keys`` group (one row when ``keys`` is empty)."""
    keys = list(keys)
    singles = (itemsets.where(F.size("items") == 1)
               .select(*keys, F.col("items")[0].alias("consequent_item"),
                       F.col("freq").alias("freq_c")))
    capped = itemsets if max_freq is None else itemsets.where(F.col("freq") <= max_freq)
    body = (capped.where(F.size("items") >= 2)
            .select(*keys, "items", "freq", F.explode("items").alias("consequent_item"))
            .withColumn("antecedent", F.array_remove("items", F.col("consequent_item"))))
    ante = capped.select(*keys, F.col("items").alias("antecedent"), F.col("freq").alias("freq_a"))
    r = (body.join(ante, [*keys, "antecedent"])
         .join(singles, [*keys, "consequent_item"]))
    r = r.join(n_baskets, keys) if keys else _attach_one(r, n_baskets)
    r = r.select(
        *keys, "antecedent", F.array("consequent_item").alias("consequent"),
        (F.col("freq") / F.col("freq_a")).alias("confidence"),
        ((F.col("freq") / F.col("freq_a")) / (F.col("freq_c") / F.col("n_baskets"))).alias("lift"),
        (F.col("freq") / F.col("n_baskets")).alias("support"))
    r = r.where(F.col("confidence") >= min_confidence)
    if min_lift is not None:
        r = r.where(F.col("lift") >= min_lift)
    return r.withColumn("rules", F.concat_ws(",", "antecedent", "consequent"))


def _attach_one(df: DataFrame, one_row: DataFrame) -> DataFrame:
    from cartwise.operators.scaling import join_scalar
    return join_scalar(df, one_row)


def association_rules(baskets: DataFrame, items: str = "items",
                      min_support: float = C.MIN_SUPPORT,
                      min_confidence: float = C.MIN_CONFIDENCE,
                      min_lift: float | None = C.MIN_LIFT,
                      max_freq: int | None = None) -> DataFrame:
    """R2/R3 over one pool of baskets; itemsets and rules are mined once."""
    sets = stored(frequent_itemsets(baskets, min_support, items), "itemsets")
    n = baskets.agg(F.count("*").alias("n_baskets"))
    return stored(derive_rules(sets, n, min_confidence, min_lift, max_freq), "rules")


def fit_groups(needs: dict[str, int], within: float = 2.0) -> list[list[str]]:
    """Areas whose minimum counts differ by at most the factor ``within``: one fit
    each, at the smallest count of the group."""
    groups: list[list[str]] = []
    for area in sorted(needs, key=lambda a: (needs[a], a)):
        if groups and needs[area] <= within * needs[groups[-1][0]]:
            groups[-1].append(area)
        else:
            groups.append([area])
    return groups


def area_fits(baskets: DataFrame, sizes: dict[str, int], items: str = "items",
              area: str = "customer_area", min_support: float = C.MIN_SUPPORT,
              within: float = 2.0) -> list[tuple[list[str], DataFrame]]:
    """One FP-growth fit for each group of areas of about the same size: (areas,
    itemsets with area at the group's smallest minimum count).

    Items are tagged with their basket's area, so an itemset never mixes areas."""
    needs = {a: math.ceil(min_support * n) for a, n in sizes.items()}
    fits = []
    for group in fit_groups(needs, within):
        own = baskets.where(F.col(area).isin(group)).select(
            F.transform(items, lambda x: F.concat(F.col(area), F.lit(TAG_SEP), x)).alias("items"))
        support = (needs[group[0]] - 0.5) / sum(sizes[a] for a in group)
        sets = frequent_itemsets(own, support, "items").select(
            F.substring_index(F.col("items")[0], TAG_SEP, 1).alias(area),
            F.transform("items", lambda x: F.substring_index(x, TAG_SEP, -1)).alias("items"),
            "freq")
        fits.append((group, sets))
    return fits


def area_itemsets(baskets: DataFrame, items: str = "items", area: str = "customer_area",
                  min_support: float = C.MIN_SUPPORT) -> tuple[DataFrame, DataFrame]:
    """R5 mining step: every area at its own count ceil(min_support * n_area).

    Areas are mined in groups of about the same size (``area_fits``); what a
    group's smallest count lets through is then held to each area's own.
    Returns (itemsets with area, basket counts per area).  The only driver
    round trip is the per-area basket count (one row per area)."""
    counts = baskets.where(F.col(area).isNotNull()).groupBy(area).agg(F.count("*").alias("n_baskets"))
    sizes = {r[area]: r["n_baskets"] for r in counts.collect()}
    if not sizes:
        empty = baskets.sparkSession.createDataFrame(
            [], f"{area} string, items array<string>, freq bigint")
        return empty, counts
    fits = [sets for _, sets in area_fits(baskets, sizes, items, area, min_support)]
    sets = reduce(DataFrame.unionAll, fits)
    sets = (sets.join(F.broadcast(counts), area)  # one row per area: size-bounded
            .where(F.col("freq") >= F.ceil(F.col("n_baskets") * F.lit(min_support)))
            .select(area, F.array_sort("items").alias("items"), "freq"))
    return sets, counts


def area_rules(baskets: DataFrame, items: str = "items", area: str = "customer_area",
               min_support: float = C.MIN_SUPPORT, min_confidence: float = C.MIN_CONFIDENCE,
               min_lift: float | None = C.MIN_LIFT, max_freq: int | None = None) -> DataFrame:
    """Rules of every area in one plan; itemsets and rules are mined once and
    stored: three reads of the itemsets of all fits made most of the matching's plan."""
    sets, counts = area_itemsets(baskets, items, area, min_support)
    rules = derive_rules(stored(sets, "itemsets"), counts, min_confidence, min_lift, max_freq, keys=[area])
    return stored(rules, "rules")


# --------------------------------------------------------------------- matching
def best_rule_per_antecedent(rules: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Within one antecedent the Jaccard score is fixed, so the winning rule is
    the one with the highest confidence, then lift, then consequent text."""
    w = Window.partitionBy(*keys, "antecedent").orderBy(
        F.desc("confidence"), F.desc("lift"), F.asc(F.concat_ws(",", "consequent")))
    return (rules.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
            .drop("_r"))


def jaccard_candidates(cust_items: DataFrame, rules: DataFrame,
                       keys: Sequence[str] = ("customer_area",),
                       cust: str = "customernumber", item: str = "item") -> DataFrame:
    """Jaccard similarity of every customer item set to every rule
    antecedent sharing at least one item (the only pairs with J > 0), via an
    inverted-index equi-join on the item instead of a customer x rule loop.

    Rows carry both item arrays (a customer's top items and an antecedent are
    short), a pair is kept at its smallest shared item only, and is scored in its
    row: no shuffle after the join.

    ``cust_items`` has one row per (keys, customer, item)."""
    keys = list(keys)
    held = cust_items.groupBy(*keys, cust).agg(F.array_sort(F.collect_set(item)).alias("_a"))
    ca = held.select(*keys, cust, "_a", F.explode("_a").alias(item))
    ante = rules.select(*keys, "antecedent").distinct()
    ante_items = ante.select(*keys, "antecedent", F.explode("antecedent").alias(item))
    n_ab = F.size(F.array_intersect("_a", "antecedent"))
    pairs = (ca.join(ante_items, [*keys, item])
             .where(F.col(item) == F.array_min(F.array_intersect("_a", "antecedent"))))
    return (pairs.select(*keys, cust, "antecedent", n_ab.cast("long").alias("n_ab"),
                         F.size("_a").cast("long").alias("n_a"), F.size("antecedent").alias("n_b"))
            .withColumn("jaccard", F.col("n_ab") / (F.col("n_a") + F.col("n_b") - F.col("n_ab"))))


def best_rule(candidates: DataFrame, rules: DataFrame, keys: Sequence[str] = ("customer_area",),
              cust: str = "customernumber") -> DataFrame:
    """Per customer the rule of highest Jaccard; ties by confidence, lift
    (desc), antecedent text, consequent text (asc).  A minimum over the whole
    order, combined before the shuffle."""
    keys = list(keys)
    best = best_rule_per_antecedent(rules, keys)
    scored = candidates.join(best, [*keys, "antecedent"]).where(F.col("jaccard") > 0)
    order = F.struct(-F.col("jaccard"), -F.col("confidence"), -F.col("lift"),
                     F.concat_ws(",", "antecedent"), F.concat_ws(",", "consequent"))
    kept = [c for c in scored.columns if c not in (*keys, cust)]
    return (scored.groupBy(*keys, cust).agg(F.min_by(F.struct(*kept), order).alias("_b"))
            .select(*keys, cust, *(F.col(f"_b.{c}").alias(c) for c in kept)))


def rare_first(rules: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """Postings of antecedents: one row per antecedent and item, the items that the
    fewest antecedents hold first (``_pos`` from 1), with the whole list in that order."""
    keys = list(keys)
    items = rules.select(*keys, "antecedent", F.explode("antecedent").alias(item))
    held = items.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("_held"))
    ordered = (items.join(held, [*keys, item]).groupBy(*keys, "antecedent")
               .agg(F.array_sort(F.collect_list(F.struct("_held", item))).alias("_o")))
    listed = ordered.select(*keys, "antecedent", F.transform("_o", lambda x: x[item]).alias("_b"))
    return listed.select(*keys, "antecedent", "_b", F.posexplode("_b").alias("_pos", item)).withColumn(
        "_pos", F.col("_pos") + 1)


def scored_pairs(cust_items: DataFrame, rules: DataFrame, keys: Sequence[str] = ("customer_area",),
                 cust: str = "customernumber", item: str = "item") -> tuple[DataFrame, DataFrame]:
    """The pairs of J6 that can hold a customer's best rule, in two disjoint parts.

    First: pairs whose antecedent's rarest item the customer holds; one posting per
    antecedent is read.  Their best score bounds the customer's best from below (t).
    Second: pairs that meet at a later item only.  To reach t the two must share
    o = t (n_a + n_b) / (1 + t) items, so an antecedent has to meet the customer
    within its first n_b - o + 1 items (prefix filter), and o is at most either size
    (length filter); the join lets no other pair through.  Equal scores stay in, as
    ties are broken by the rules."""
    keys = list(keys)
    posts = stored(rare_first(rules.select(*keys, "antecedent").distinct(), keys, item), "postings")
    held = stored(cust_items.where(F.col(item).isNotNull()).groupBy(*keys, cust)
                  .agg(F.array_sort(F.collect_set(item)).alias("_a")), "held")
    n_a, n_b = F.size("_a"), F.size("_b")

    def score(pairs: DataFrame) -> DataFrame:
        n_ab = F.size(F.array_intersect("_a", "_b"))
        return (pairs.select(*keys, cust, "antecedent", n_ab.cast("long").alias("n_ab"),
                             n_a.cast("long").alias("n_a"), n_b.alias("n_b"))
                .withColumn("jaccard", F.col("n_ab") / (F.col("n_a") + F.col("n_b") - F.col("n_ab"))))

    first = score(held.select("*", F.explode("_a").alias(item))
                  .join(posts.where("_pos = 1"), [*keys, item]))
    reached = held.join(first.groupBy(*keys, cust).agg(F.max("jaccard").alias("_t")), [*keys, cust], "left")
    left = reached.select("*", F.explode("_a").alias(item)).withColumn("_t", F.coalesce("_t", F.lit(0.0)))
    shared = F.greatest(F.ceil(F.col("_t") * (n_a + n_b) / (1 + F.col("_t")) - 1e-9), F.lit(1))
    met = F.array_intersect("_b", "_a")  # in the order of _b: rarest first
    second = score(left.join(posts.where("_pos > 1"), [*keys, item])
                   .where((F.col("_pos") <= n_b - shared + 1) & (shared <= n_a) & (met[0] == F.col(item))))
    return first, second


def best_match(cust_items: DataFrame, rules: DataFrame, keys: Sequence[str] = ("customer_area",),
               cust: str = "customernumber", item: str = "item") -> DataFrame:
    """W5 without the whole of J6: the same rows as ``best_rule`` over
    ``jaccard_candidates``."""
    first, second = scored_pairs(cust_items, rules, keys, cust, item)
    return best_rule(first.unionByName(second), rules, keys, cust)


def match_rules(top: DataFrame, actual: DataFrame, rules: DataFrame,
                keys: Sequence[str] = ("customer_area",), cust: str = "customernumber",
                item: str = "item") -> DataFrame:
    """Customer -> best rule -> bundle (antecedent ++ consequent).

    ``top`` has one row per (keys, customer, item) of the customer's top
    items, ``actual`` one row per customer with the rank-ordered list."""
    best = best_match(top, rules, keys, cust, item)
    return (actual.join(best, [*keys, cust])
            .select(*keys, cust, "actual_products",
                    F.col("antecedent").alias("highest_similarity"), "consequent",
                    "confidence", "lift", "jaccard",
                    F.concat("antecedent", "consequent").alias("rules")))
