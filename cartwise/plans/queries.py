"""Registry of named queries, one per operator of the inventory.

Each entry is ``f(spark, sf_dir) -> DataFrame`` over the driver's test tables.
Floating outputs are rounded to 6 digits and dates rendered ISO so the
result can be compared value by value with the SQL oracle."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwise import config as C
from cartwise.config import BundleConfig
from cartwise.functions.text import name_prefix
from cartwise.operators import rules as R
from cartwise.operators.windows import baskets, top_items
from cartwise.plans import bundles as B
from cartwise.plans import dataset as D
from cartwise.plans import models as MO
from cartwise.scope import once, persist, scope, shared, stored
from cartwise.sources import testdata as TD

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, root: str) -> DataFrame:
            with scope(shared((spark.sparkContext.applicationId, root))):
                return fn(spark, root)
        QUERIES[name] = run
        return fn
    return deco


def r6(col: str) -> F.Column:
    return F.round(F.col(col), 6).alias(col)


def money(col: str, digits: int = 6) -> F.Column:
    """Half-up rounding of sums and means of amounts, free of the order of summing:
    noise beyond eight places is cut off first."""
    return F.round(F.col(col).cast("decimal(28,8)"), digits).cast("double").alias(col)


# ---------------------------------------------------------------- building blocks
def invoices(spark: SparkSession, root: str) -> DataFrame:
    """The invoice fact of ``root``: one lazy plan, so that filters on it reach the
    scans.  What a query reads several times it persists further on."""
    return once(("invoices", root), lambda: D.build_invoices(TD.sources(spark, root)))


def columns(spark: SparkSession, root: str, *names: str, merged: bool = True) -> DataFrame:
    """``names`` of the invoice fact, built from these columns alone; lazy."""
    return D.invoice_columns(TD.sources(spark, root), names, merged)


RATED = ["customer_area", "customernumber", "model_number"]
FACT_COLUMNS = ["customer_area", "customernumber", "sales_receipt", "soldnumber", "product_name", "product_family"]


def fact(spark: SparkSession, root: str) -> DataFrame:
    """What bundles of names read of the invoice fact, stored: they read it in several
    branches."""
    return once(("fact", root), lambda: stored(columns(spark, root, *FACT_COLUMNS), "fact"))


def product_rows(spark: SparkSession, root: str) -> DataFrame:
    """D2 over the whole history, stored; identical lines make no difference to it."""
    return once(("products", root), lambda: stored(D.product_list(columns(
        spark, root, "model_number", "product_name", "product_family", "product_class", "product_group", "product_field",
        merged=False)), "products"))


def window(spark: SparkSession, root: str) -> DataFrame:
    return D.invoice_window(invoices(spark, root), TD.AS_OF)


def ratings(spark: SparkSession, root: str, item: str = "model_number") -> DataFrame:
    return D.customer_ratings(window(spark, root), item=item)


def all_ratings(spark: SparkSession, root: str) -> DataFrame:
    """D3 over the whole history, for operators that have no window."""
    return D.customer_ratings(columns(spark, root, *RATED, "soldnumber"))


def top10(spark: SparkSession, root: str, item: str = "model_number", rated: DataFrame | None = None) -> DataFrame:
    return top_items(ratings(spark, root, item) if rated is None else rated, C.TOP_ITEMS_PER_CUSTOMER,
                     ["customer_area", "customernumber"], "interaction", item)


def als_input(spark: SparkSession, root: str, index: bool = True) -> DataFrame:
    """L1 over all areas; what it is worked out from is kept: several queries and branches
    read it."""
    return once(("als", root, index), lambda: MO.als_ratings(
        columns(spark, root, *RATED, "sales_value"), cap=C.RATING_CAP, index=index))


def ncf_input(spark: SparkSession, root: str) -> DataFrame:
    """L6 over all areas, stored."""
    return once(("ncf", root), lambda: stored(MO.ncf_ratings(
        columns(spark, root, *RATED, "soldnumber", "sales_year", "sales_month"), cap=C.RATING_CAP), "ncf"))


# ---------------------------------------------------------------- D / W slice
@register("build_invoices")
def q_build_invoices(spark, root):
    inv = invoices(spark, root)
    return inv.withColumns({
        "calendar_day": F.date_format("calendar_day", "yyyy-MM-dd"),
        "order_date": F.date_format("order_date", "yyyy-MM-dd"),
        "sales_value": F.round("sales_value", 6)})


@register("customer_ratings")
def q_customer_ratings(spark, root):
    r = ratings(spark, root)
    return r.select("customer_area", "customernumber", "model_number", "product_orders",
                    "avg_order", r6("raw_rating"), r6("rating"), "interaction")


@register("top10_per_customer")
def q_top10(spark, root):
    return top10(spark, root).select("customer_area", "customernumber", "model_number",
                                     "row", "interaction")


def arr(col: str) -> F.Column:
    """Arrays leave as comma-joined text (order kept)."""
    return F.concat_ws(",", F.col(col)).alias(col)


# The fixed thresholds over the whole history: an area's minimum count is 3 at sf0.01.
FLAG_CFG = BundleConfig(item_col="product_name")


def pooled_baskets(spark, root):
    inv = invoices(spark, root).withColumn("item", name_prefix("product_name"))
    return once(("pooled", root), lambda: persist(baskets(inv, ("customernumber", "sales_receipt"), "item").withColumnRenamed(
        "item", "items")))


def pooled_rules(spark, root, min_conf=0.05, min_lift=1.0, max_freq=None):
    return once(("rules", root, min_conf, min_lift, max_freq), lambda: R.association_rules(
        pooled_baskets(spark, root), "items", 0.001, min_conf, min_lift, max_freq))


def rule_out(df, keys=()):
    return df.select(*keys, arr("antecedent"), arr("consequent"), r6("confidence"), r6("lift"),
                     r6("support"))


def parts(spark, root) -> B.BundleParts:
    """Intermediate frames of the run at the fixed thresholds, shared within one query."""
    return once(("parts", root), lambda: B.bundle_parts(fact(spark, root), FLAG_CFG))


# ---------------------------------------------------------------- rules
@register("baskets")
def q_baskets(spark, root):
    return parts(spark, root).baskets.select("customer_area", "customernumber", "sales_receipt",
                                             arr("items"), "count")


@register("frequent_itemsets")
def q_frequent_itemsets(spark, root):
    sets = R.frequent_itemsets(pooled_baskets(spark, root), 0.001, "items")
    return sets.select(arr("items"), F.size("items").alias("size"), "freq")


@register("association_rules")
def q_association_rules(spark, root):
    return rule_out(pooled_rules(spark, root))


@register("capped_rules")
def q_capped_rules(spark, root):
    return rule_out(pooled_rules(spark, root, max_freq=900))


@register("lift_floor")
def q_lift_floor(spark, root):
    from cartwise.operators.filters import min_lift
    r = min_lift(pooled_rules(spark, root, min_lift=None), 1.0)
    return r.select(arr("antecedent"), arr("consequent"), r6("lift"))


@register("freq_cap")
def q_freq_cap(spark, root):
    from cartwise.operators.filters import cap_frequency
    sets = cap_frequency(R.frequent_itemsets(pooled_baskets(spark, root), 0.001, "items"), 900)
    return sets.select(arr("items"), "freq")


@register("all_area_rules")
def q_all_area_rules(spark, root):
    return rule_out(parts(spark, root).rules, ["customer_area"])


@register("jaccard_join")
def q_jaccard_join(spark, root):
    p = parts(spark, root)
    c = R.jaccard_candidates(p.top, p.rules, ["customer_area"], "customernumber", "item")
    return c.select("customer_area", "customernumber", arr("antecedent"), "n_ab", "n_a", "n_b",
                    r6("jaccard"))


@register("best_rule")
def q_best_rule(spark, root):
    p = parts(spark, root)
    b = R.best_match(p.top, p.rules, ["customer_area"], "customernumber", "item")
    return b.select("customer_area", "customernumber", arr("antecedent"), arr("consequent"),
                    r6("jaccard"), r6("confidence"), r6("lift"))


@register("bundle_by_rule")
def q_bundle_by_rule(spark, root):
    m = parts(spark, root).matched
    return m.select("customer_area", "customernumber", arr("actual_products"),
                    arr("highest_similarity"), arr("consequent"), r6("confidence"), r6("lift"),
                    r6("jaccard"), arr("rules"))


@register("match_split")
def q_match_split(spark, root):
    from cartwise.operators.filters import split_matched
    p = mixed_parts(spark, root)
    every = p.actual.join(p.matched.select("customer_area", "customernumber", "confidence"),
                          ["customer_area", "customernumber"], "left")
    matched, rest = split_matched(every)
    return (matched.select("customer_area", "customernumber", F.lit(True).alias("matched"))
            .unionByName(rest.select("customer_area", "customernumber", F.lit(False).alias("matched"))))


# ---------------------------------------------------------------- similarity
SIM_CFG = BundleConfig(as_of=None, item_col="model_number")


def sim_parts(spark, root, with_names: bool = True) -> B.BundleParts:
    def build():
        # lazy: a reader of some of these columns carries no others past the merging of lines
        inv = columns(spark, root, *RATED, "sales_receipt", "soldnumber", "product_family")
        return B.bundle_parts(inv, SIM_CFG, product_rows(spark, root) if with_names else None)
    return once(("sim", root, with_names), build)


def sim_bought(spark, root):
    from cartwise.operators import similarity as S
    r = sim_parts(spark, root, False).ratings
    return S.purchases(r, ["customer_area"], "customernumber", "model_number")


@register("cooccurrence_join")
def q_cooccurrence(spark, root):
    from cartwise.operators import similarity as S
    return S.co_purchase(sim_bought(spark, root), ["customer_area"]).drop("n_a", "n_b")


@register("item_cosine")
def q_item_cosine(spark, root):
    from cartwise.operators import similarity as S
    s = S.item_cosine(sim_bought(spark, root), ["customer_area"])
    return s.select("customer_area", "item", "other", "co", r6("sim"))


@register("top2_similar")
def q_top2(spark, root):
    return sim_parts(spark, root, False).neighbours.select(
        "customer_area", "item", "other", "rank", "sim_score")


@register("first_n_items")
def q_first_n(spark, root):
    from cartwise.operators.windows import head_items
    u = sim_parts(spark, root, False).unmatched
    return u.select("customer_area", "customernumber",
                    F.concat_ws(",", head_items("actual_products", C.FALLBACK_ITEMS_PER_CUSTOMER))
                    .alias("head_items"))


@register("neighbour_join")
def q_neighbour_join(spark, root):
    from cartwise.operators import similarity as S
    p = sim_parts(spark, root, False)
    return S.head_neighbours(p.unmatched, p.neighbours).select(
        "customer_area", "customernumber", "item", "other", "rank", "sim_score")


@register("name_lookup")
def q_name_lookup(spark, root):
    from cartwise.operators import similarity as S
    p = sim_parts(spark, root, False)
    rows = S.attach_names(S.head_neighbours(p.unmatched, p.neighbours),
                          product_rows(spark, root))
    return rows.select("customer_area", "customernumber", "item", "other",
                       "actual_product_name", "similar_product_name")


@register("set_string_agg")
def q_set_string_agg(spark, root):
    from cartwise.operators import similarity as S
    p = sim_parts(spark, root, False)
    rows = S.head_neighbours(p.unmatched, p.neighbours)
    reco = S.collect_recommendations(rows)
    sc = S.score_lists(rows)
    return (reco.join(sc, ["customer_area", "customernumber", "item"])
            .select("customer_area", "customernumber", "item", arr("most_similar_items"),
                    arr("sim_score")))


def fallback_out(df):
    return df.select("customer_area", "customernumber", arr("actual_products"),
                     arr("most_similar_items"), arr("sim_score"), arr("recommend"),
                     arr("recommend_name"), "rules_count")


@register("item_fallback")
def q_item_fallback(spark, root):
    return fallback_out(sim_parts(spark, root).fallback)


@register("score_left_join")
def q_score_left_join(spark, root):
    """Only scores of 0.5 and more are kept, so some recommendations stay without."""
    from cartwise.operators import similarity as S
    p = sim_parts(spark, root, False)
    rows = S.head_neighbours(p.unmatched, p.neighbours)
    strong = S.score_lists(rows.where("sim_score >= 0.5"))
    return S.score_left_join(S.collect_recommendations(rows), strong).select(
        "customer_area", "customernumber", "item", arr("most_similar_items"), arr("sim_score"))


def bundles_out(df):
    return df.select("customer_area", "customernumber", arr("actual_products"),
                     arr("most_similar_items"), arr("recommend"),
                     F.concat_ws(",", F.transform("sim_score", lambda x: F.round(x, 6)))
                     .alias("sim_score"), "method")


# A run in which some customers match a rule and others fall back on neighbours: the
# whole history and the fixed support, with a higher confidence.
MIXED_CFG = BundleConfig(item_col="product_name", min_confidence=0.7)


def mixed_parts(spark, root) -> B.BundleParts:
    return once(("mixed", root), lambda: B.bundle_parts(fact(spark, root), MIXED_CFG))


@register("bundle_pipeline")
def q_bundle_pipeline(spark, root):
    return bundles_out(B.union_bundles(mixed_parts(spark, root)))


FLAGSHIP = "bundle_pipeline"

from cartwise.plans import queries_ops  # noqa: E402,F401  (registers more queries)
from cartwise.plans import queries_models  # noqa: E402,F401
