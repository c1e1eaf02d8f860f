"""The Merkle manifest against plain loops, and its layout."""

import random

import numpy as np

from cartwise.llm import merkle_manifest as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def check(spark, rows):
    out = M.verify_documents(spark.createDataFrame(rows, SCHEMA))
    got = [tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    assert sorted(got, key=str) == sorted(M.brute_force(rows), key=str)


def test_addresses_are_a_layout_by_halves():
    for levels in range(1, 6):
        places = np.concatenate([M.address(levels, d, np.arange(M.FANOUT ** d)) for d in range(levels)])
        assert sorted(places) == list(range(M.subtree(levels)))
    # four levels: the top two first, then each lower subtree of two levels together
    assert M.address(4, 2, np.array([0, 1])).tolist() == [9, 18]
    assert M.address(4, 3, np.array([0, 7, 8])).tolist() == [10, 17, 19]


def test_matches_plain_loops(spark):
    r = random.Random(1)
    rows = [(i * 3, "s%d" % (i % 4), r.choice(["en", "fr", "é", None, "zz"]), i, r.choice(["Some Text", "low", "", None])) for i in range(300)]
    check(spark, rows)


def test_ragged_blocks():
    for n in (1, 2, 8, 9, 64, 65, 513):
        block = M.Block(n, M.steps_of(n))
        leaves = [M._sha(str(i)) for i in range(n)]
        now = leaves
        for _ in range(block.levels - 1):
            now = [M._sha("".join(now[i:i + 8])) for i in range(0, len(now), 8)]
        assert block.build(leaves) == now[0]


def test_more_than_a_block(spark):
    rows = [(i, None, "en" if i % 50 else "fr", 1, "T%d" % i) for i in range(4200)]
    check(spark, rows)


def test_nulls_ties_repeats_and_empty(spark):
    rows = [(None, None, None, None, None), (None, "s", None, 1, "A"), (1, "s", "en", 1, "X"), (1, "s", "en", 1, "X"),
            (1, "s", "en", 1, "A"), (2, None, "", 0, ""), (7, "s", "en", 1, "Z" * 10000)] + [(5, "s", "en", 1, "X")] * 20
    check(spark, rows)
    check(spark, rows[:1])
    assert M.verify_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_trees(spark):
    check(spark, [(i, "s", "l%d" % (i % 700), 1, "T") for i in range(1500)])


def test_other_columns_are_left_out(spark):
    df = spark.createDataFrame([(1, "s", "en", 1, "X", "a", 2)], SCHEMA + ", tree string, digest int")
    assert M.verify_documents(df).columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
