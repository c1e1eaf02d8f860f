"""Embedding near-duplicates against brute force."""

import numpy as np

from cartwise.llm import embedding_dedup as E


def rows(n=150, width=16, seed=1):
    g = np.random.default_rng(seed)
    base = g.normal(size=(n, width)).astype(np.float32)
    near = base[g.integers(0, n, n)] + g.normal(size=(n, width)).astype(np.float32) * g.choice([0.1, 0.4, 0.5], (n, 1))
    out = [x.astype(np.float32).tolist() for x in np.concatenate([base, near])]
    out += [out[0]] * 5 + [None, [], [0.0] * width, [float("nan")] * width, [float("inf")] + [0.0] * (width - 1),
                           [None] + [1.0] * (width - 1), out[1][:8], [2 * x for x in out[2]], [-x for x in out[3]]]
    return list(enumerate(out))


def run(spark, data, **more):
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").selectExpr("*", "1 as label", "2 as n_links")
    return {r[0]: tuple(r)[1:] for r in E.near_duplicates(df.repartition(3), **more).collect()}


def test_matches_brute_force(spark):
    data = rows()
    assert run(spark, data) == E.brute_force(data)


def test_many_blocks_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK_ROWS", 40)
    data = rows(120, 8, 2)
    assert run(spark, data, least=0.8) == E.brute_force(data, 0.8)


def test_parallel_vectors(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK_ROWS", 10)
    data = [(i, [float(i + 1)]) for i in range(30)] + [(99, [-1.0])]
    got = run(spark, data)
    assert got[5] == (29, 0, False) and got[99] == (0, 99, True)


def test_nothing_to_compare(spark):
    assert run(spark, []) == {}
    assert run(spark, [(1, None), (2, [0.0])]) == {1: (0, 1, True), 2: (0, 2, True)}
    assert run(spark, [(None, [1.0]), (2, [1.0]), (3, [2.0])])[None] == (0, None, False)


def test_forest_keeps_components():
    g = np.random.default_rng(3)
    a, b = g.integers(0, 300, 200), g.integers(0, 300, 200)
    child, root = E.forest(a, b)
    again = E.forest(child, root)
    assert (again[0] == child).all() and (again[1] == root).all()
    assert set(child) | set(root) == set(a[a != b]) | set(b[a != b])


def test_rows_that_share_an_id_stay_themselves(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0])]
    got = E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]
