"""SimHash near-duplicates against brute force."""

import random

import numpy as np
import pytest

from cartwise.llm import simhash


def rows(seed=1, n=60):
    r = random.Random(seed)
    base = [[r.choice("abcdefghijklmnop") + str(r.randint(0, 99)) for _ in range(200)] for _ in range(n)]
    out = []
    for i, words in enumerate(base):
        out.append(" ".join(words))
        for _ in range(r.randint(0, 3)):
            near = list(words)
            near[r.randrange(200)] = "X"
            out.append(" \n".join(near))
    out += [None, "", " \t", "one", "ONE", "one two", "é è ê à", out[0], out[0].upper()]
    return list(enumerate(out))


def test_matches_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("fingerprint", simhash.F.lit(1))
    got = {r[0]: (r[1], r[2]) for r in simhash.near_duplicates(df, 3, 3).collect()}
    assert got == simhash.brute_force(data)
    kept = {r[0] for r in simhash.keep_one(df, 3, 3).collect()}
    assert kept == {c for _, c in got.values()}


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_links_connect_all_within_the_radius(spark, radius):
    g = np.random.default_rng(radius)
    centres = g.integers(0, 1 << 63, 12).tolist()
    prints = set()
    for c in centres:
        for _ in range(12):
            x = c
            for b in g.choice(64, g.integers(0, 5), replace=False):
                x ^= 1 << int(b)
            prints.add(x)
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    found = simhash.links(spark.createDataFrame(signed, "print long"), radius, 4).collect()
    names = [p[0] for p in signed]
    want = {n: n for n in names}
    got = dict(want)

    def root(parent, x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                ra, rb = root(want, names[i]), root(want, names[j])
                want[max(ra, rb)] = min(ra, rb)
    for row in found:
        assert ((row["a"] ^ row["b"]) & ((1 << 64) - 1)).bit_count() <= radius
        ra, rb = root(got, row["a"]), root(got, row["b"])
        got[max(ra, rb)] = min(ra, rb)
    assert {n: root(got, n) for n in names} == {n: root(want, n) for n in names}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.keep_one(df).count() == 0


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (None, "x y z w")], "doc_id long, text string")
    got = {(r[0], r[2]) for r in simhash.near_duplicates(df).collect()}
    assert got == {(None, 5), (5, 5), (None, None)}
    assert simhash.keep_one(df).count() == 3


def test_rows_that_share_an_id_stay_themselves(spark):
    one, two = ("w%d " * 30 % tuple(range(30)), "v%d " * 30 % tuple(range(30)))
    df = spark.createDataFrame([(1, one), (1, two), (2, one), (3, two), (4, "alone here")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]
    kept = sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(df).collect())
    assert kept == [(1, two), (1, one), (4, "alone here")]


def test_a_copy_elsewhere_takes_no_clean_row_along(spark):
    one, own = ("w%d " * 30 % tuple(range(30)), "v%d " * 30 % tuple(range(30)))
    rows = [(1, one), (5, one), (5, own), (5, own), (6, None), (7, "")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r[0], r[1]) for r in got if r[0] < 6) == [(1, one), (5, own), (5, own)]
    assert [r[0] for r in got if r[0] >= 6] == [6]
