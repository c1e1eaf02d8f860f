"""Properties of the bundle pipeline on the smallest driver tables."""

import os

import pytest
from pyspark.sql import functions as F

from cartwise.config import BundleConfig
from cartwise.operators import similarity as S
from cartwise.plans import bundles as B
from cartwise.plans import dataset as D
from cartwise.sources import testdata as TD

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="test data not present")


@pytest.fixture(scope="module")
def parts(spark):
    inv = D.build_invoices(TD.sources(spark, ROOT)).persist()
    yield B.bundle_parts(inv, BundleConfig(as_of=None, item_col="model_number",
                                           min_confidence=0.1))
    spark.catalog.clearCache()


def test_ratings_in_range_and_top_k_bounded(parts):
    r = parts.ratings.agg(F.min("interaction"), F.max("interaction")).first()
    assert 0.0 <= r[0] and r[1] <= 10.0
    per = parts.top.groupBy("customer_area", "customernumber").count()
    assert per.agg(F.max("count")).first()[0] <= 10


def test_matched_and_unmatched_partition_customers(parts):
    key = ["customer_area", "customernumber"]
    actual = {tuple(r) for r in parts.actual.select(*key).collect()}
    matched = {tuple(r) for r in parts.matched.select(*key).collect()}
    unmatched = {tuple(r) for r in parts.unmatched.select(*key).collect()}
    assert matched | unmatched == actual and not (matched & unmatched)


def test_rule_thresholds_hold(parts):
    bad = parts.rules.where((F.col("confidence") < 0.1) | (F.col("lift") < 1.0)
                            | (F.col("support") <= 0) | (F.col("confidence") > 1.0))
    assert bad.count() == 0


def test_cosine_symmetric_and_bounded(parts):
    bought = S.purchases(parts.ratings)
    sims = S.item_cosine(bought)
    assert sims.where((F.col("sim") <= 0) | (F.col("sim") > 1.0 + 1e-12)).count() == 0
    a = sims.alias("a")
    b = sims.alias("b")
    mism = a.join(b, (F.col("a.customer_area") == F.col("b.customer_area"))
                  & (F.col("a.item") == F.col("b.other")) & (F.col("a.other") == F.col("b.item")),
                  "left_anti")
    assert mism.count() == 0
    assert parts.neighbours.groupBy("customer_area", "item").count().agg(
        F.max("count")).first()[0] <= 2
