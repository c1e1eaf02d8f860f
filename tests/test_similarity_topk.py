"""The bounded top-k similarity join gives what scoring every pair gives."""

import random

import pytest

from cartwise.operators import similarity as S


def bought(spark, seed, customers=80, items=60, most=14):
    r = random.Random(seed)
    rows = {("a" if c % 3 else None if c % 7 == 0 else "b", "c%d" % c, "item %02d" % int(items * r.random() ** 1.5))
            for c in range(customers) for _ in range(r.randint(1, most))}
    return spark.createDataFrame(sorted(rows, key=str), "customer_area string, customernumber string, item string")


@pytest.mark.parametrize("seed, k, chunk", [(1, 2, 1024), (2, 1, 3), (3, 5, 4)])
def test_equal_to_scoring_every_pair(spark, seed, k, chunk):
    b = bought(spark, seed).where("customer_area is not null")
    every = S.top_similar(S.item_cosine(b, chunk=chunk), k)
    names = ["customer_area", "item", "other", "co", "sim", "rank", "sim_score"]
    got = S.top_similar_items(b, k, chunk=chunk)
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, every.select(*names).collect()))


def test_most_pairs_are_never_sorted(spark):
    b = bought(spark, 4, customers=400, items=300).where("customer_area is not null")
    keys = ["customer_area"]
    ids = S.item_ids(b, keys)
    pairs = S.pair_counts(b, ids, keys, "customernumber", 1024).checkpoint()
    assert 3 * S.reaching(pairs, 2).count() < pairs.count()  # of twice as many directions


def test_nothing_bought(spark):
    assert S.top_similar_items(bought(spark, 1).limit(0)).count() == 0
