"""Scratch tables, gapless numbers and components."""

import os
import random

import pytest
from pyspark.sql import functions as F

from cartwise.llm import common


def test_scratch_tables_can_be_cleared(spark):
    df = common.materialize(spark.range(5), "t")
    path = common._written[-1]
    assert df.count() == 5 and os.path.isdir(path)
    common.clear_scratch(spark)
    assert not os.path.exists(path) and not common._written


def test_gapless(spark):
    r = random.Random(1)
    rows = [(r.choice("aab"), i) for i in range(1000)]
    got = common.gapless(spark.createDataFrame(rows, "g string, i long"), ["g"], [F.col("i")], F.xxhash64("i"), 7, "n").collect()
    assert len(got) == 1000
    for g in "ab":
        assert sorted(x["n"] for x in got if x["g"] == g) == list(range(sum(a == g for a, _ in rows)))


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    r = random.Random(2)
    n = 300
    edges = {"path": [(i, i + 1) for i in range(n - 1)], "star": [(7, i) for i in range(n)],
             "random": [(r.randrange(n), r.randrange(n)) for _ in range(200)]}[shape]
    names = list(range(n))
    r.shuffle(names)
    edges = [(names[a], names[b]) for a, b in edges]
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    nodes = spark.range(n).withColumnRenamed("id", "node")
    got = {x["node"]: x["component"] for x in common.components(
        nodes, spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {i: root(i) for i in range(n)}
