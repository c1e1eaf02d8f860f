"""Short itemsets are counted, larger ones grown over what can hold them."""

import random

import pytest
from pyspark.sql import functions as F

from cartwise.operators import rules as R


def made(spark, n=300, seed=5, often=True):
    rnd = random.Random(seed)
    held = [rnd.sample("abcdefghij", rnd.randint(0, 6)) + (["p", "q", "r", "s"] if often and i % 3 == 0 else [])
            for i in range(n)]
    return spark.createDataFrame([(h,) for h in held] + [(None,)], "items array<string>").repartition(3)


def rows(sets):
    return sorted((tuple(r["items"]), r["freq"]) for r in sets.collect())


@pytest.mark.parametrize("support", [0.5, 0.2, 0.03, 0.004])
def test_counted_and_grown_sets_equal_fp_growth(spark, support):
    b = made(spark)
    assert rows(R.frequent_itemsets(b, support)) == rows(R.grown_itemsets(b.dropna(), support))


@pytest.mark.parametrize("name, value", [("SETS_PER_ITEM", 0), ("SETS_PER_ITEM", 2), ("SETS_PER_BASKET", 45), ("LISTED", 20), ("LISTED", 3)])
def test_every_way_gives_the_same_sets(spark, monkeypatch, name, value):
    b = made(spark)
    want = rows(R.grown_itemsets(b.dropna(), 0.03))
    monkeypatch.setattr(R, name, value)
    assert rows(R.frequent_itemsets(b, 0.03)) == want


def test_no_tree_is_grown_without_frequent_triples(spark, monkeypatch):
    b = made(spark, often=False)
    want = rows(R.grown_itemsets(b.dropna(), 0.09))
    assert max(len(s) for s, _ in want) == 2
    monkeypatch.setattr(R, "grown_itemsets", None)
    assert rows(R.frequent_itemsets(b, 0.09)) == want


def test_odd_baskets(spark):
    assert rows(R.frequent_itemsets(spark.createDataFrame([], "items array<string>"), 0.1)) == []
    assert rows(R.frequent_itemsets(spark.createDataFrame([([],), ([],)], "items array<string>"), 0.1)) == []
    numbers = spark.createDataFrame([([3, 1],), ([1, 2, 3],), ([2],)], "items array<int>")
    assert rows(R.frequent_itemsets(numbers, 0.5)) == [((1,), 2), ((1, 3), 2), ((2,), 2), ((3,), 2)]
    with pytest.raises(ValueError):
        R.frequent_itemsets(spark.createDataFrame([(["a", "a"],)], "items array<string>"), 0.1)
    assert R.frequent_itemsets(numbers, 0.5).where(F.size("items") == 0).count() == 0
