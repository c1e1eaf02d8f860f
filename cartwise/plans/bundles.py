"""Flagship pipeline (I3): rule bundles for matched customers, cosine
neighbour bundles for the rest, all areas in one plan (U1)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.config import BundleConfig
from cartwise.functions.text import name_prefix
from cartwise.operators import filters as FL
from cartwise.operators import rules as R
from cartwise.operators import similarity as S
from cartwise.operators.aggregates import union_results
from cartwise.operators.windows import baskets, ranked_list, top_items
from cartwise.plans import dataset as D
from cartwise.scope import stored

AREA, CUST = "customer_area", "customernumber"


def prepare(invoices: DataFrame, cfg: BundleConfig) -> DataFrame:
    """F10 window (when ``as_of`` is set) and X1 name cleaning for name items."""
    inv = invoices
    if cfg.as_of:
        inv = D.invoice_window(inv, cfg.as_of, cfg.trailing_months)
    if cfg.item_col == "product_name":
        inv = inv.withColumn("product_name", name_prefix("product_name"))
    return inv


class BundleParts:
    """Intermediate frames of one bundle run.  Each is built on first access,
    so asking for the neighbours alone never runs FP-growth."""

    def __init__(self, invoices: DataFrame, cfg: BundleConfig,
                 products: DataFrame | None = None):
        self.cfg, self.products = cfg, products
        self.inv = prepare(invoices, cfg)
        self.item = cfg.item_col

    @cached_property
    def ratings(self) -> DataFrame:
        """Read by the top-k, matching and cosine branches.  What they are scaled from
        is stored, so they are built once up to the scaling of a row."""
        return D.customer_ratings(self.inv, item=self.item, cap=self.cfg.rating_cap)

    @cached_property
    def top(self) -> DataFrame:
        """One row per (area, customer, item) of each customer's top items; stored, as
        lists, matching and marks read it."""
        t = top_items(self.ratings, self.cfg.top_items, [AREA, CUST], "interaction", self.item)
        return stored(FL.dropna_any(t.select(AREA, CUST, F.col(self.item).alias("item"), "row",
                                             "interaction")), "top")

    @cached_property
    def actual(self) -> DataFrame:
        """One row per (area, customer) with the rank-ordered item list."""
        return ranked_list(self.top, [AREA, CUST], "item", "row", "actual_products")

    @cached_property
    def baskets(self) -> DataFrame:
        src = FL.exclude_families(self.inv, self.cfg.excluded_families)
        return stored(baskets(src, (AREA, CUST, "sales_receipt"), self.item)
                      .withColumnRenamed(self.item, "items"), "baskets")  # counted and mined

    @cached_property
    def rules(self) -> DataFrame:
        c = self.cfg
        return R.area_rules(self.baskets, "items", AREA, c.min_support, c.min_confidence,
                            c.min_lift, c.max_itemset_freq)

    @cached_property
    def matched(self) -> DataFrame:
        """One row per matched customer; read by the rule bundles and by the
        unmatched split, so it is stored (small: bounded by customers)."""
        return stored(R.match_rules(self.top, self.actual, self.rules, [AREA], CUST, "item"), "matched")

    @cached_property
    def unmatched(self) -> DataFrame:
        return self.actual.join(self.matched.select(AREA, CUST), [AREA, CUST], "left_anti")

    @cached_property
    def neighbours(self) -> DataFrame:
        bought = S.purchases(self.ratings, [AREA], CUST, self.item,
                             use_raw=self.cfg.use_raw_purchases)
        # k rows per item; pairs are the largest shuffle and go with this run
        return stored(S.top_similar_items(bought, self.cfg.neighbours, [AREA], CUST), "neighbours")

    @cached_property
    def fallback(self) -> DataFrame:
        return S.fallback_bundles(self.unmatched, self.neighbours, self.products, [AREA], CUST,
                                  self.cfg.fallback_items)


def bundle_parts(invoices: DataFrame, cfg: BundleConfig,
                 products: DataFrame | None = None) -> BundleParts:
    return BundleParts(invoices, cfg, products)


def union_bundles(parts: BundleParts) -> DataFrame:
    """Both bundle kinds over one schema (method tells them apart)."""
    by_rule = parts.matched.select(
        AREA, CUST, F.col("highest_similarity").alias("actual_products"),
        F.col("consequent").alias("most_similar_items"), F.col("rules").alias("recommend"),
        F.array(F.col("confidence")).alias("sim_score"), F.lit("rule").alias("method"))
    by_sim = parts.fallback.select(
        AREA, CUST, "actual_products", "most_similar_items", "recommend",
        F.col("sim_score").cast("array<double>").alias("sim_score"),
        F.lit("similarity").alias("method"))
    return union_results(by_rule, by_sim)


def recommend_bundles(invoices: DataFrame, cfg: BundleConfig,
                      products: DataFrame | None = None) -> DataFrame:
    """The bundle table for every customer area."""
    return union_bundles(bundle_parts(invoices, cfg, products))
