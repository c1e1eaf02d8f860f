"""Ranked search against plain loops."""

import random

import numpy as np

from cartwise.llm import bytetext as B
from cartwise.llm import lexical_search as S


def check(spark, docs, items, top=5):
    got = S.search(spark.createDataFrame(docs, "doc_id long, text string"),
                   spark.createDataFrame(items, "item_id long, text string"), top)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(S.brute_force(docs, items, top), key=str)


def words(r, n, kinds=400):
    return " ".join("w%d" % int(kinds * r.random() ** 3) for _ in range(n))


def test_hashes_differ_for_padded_and_long_words():
    words = ["a", "a\0", "ab", "abcdefgh", "abcdefgh\0", "abcdefghi", "b" * 1024, "b" * 1023 + "c"]
    text = " ".join(words).encode()
    texts = B.Texts(np.frombuffer(text, np.uint8), np.array([0, len(text)])).words(B.NON_SPACE)
    assert len(set(B.lane_hashes(texts).tolist())) == len(words)


def test_matches_plain_loops(spark, monkeypatch):
    r = random.Random(3)
    docs = [(i, words(r, r.choice([1, 5, 40, 300])) + r.choice(["", " Éa, W7!", "\nw3 w3 w3 w3 w3"])) for i in range(250)]
    items = [(i, words(r, 12)) for i in range(15)] + [(99, "nothing here"), (100, "Éa w399")]
    check(spark, docs, items)
    monkeypatch.setattr(S, "QUERY_ITEMS", 4)  # several blocks of queries
    monkeypatch.setattr(S, "BROADCAST_DOCS", 0)
    check(spark, docs, items, 50)


def test_nulls_ties_repeats_and_long_texts(spark):
    docs = [(None, "alpha beta"), (None, None), (1, ""), (2, "alpha beta"), (2, "alpha beta"), (2, "gamma"), (3, "alpha " * 30_000),
            (4, "Beta alpha?"), (5, "delta"), (6, " .;")] + [(i, "alpha beta") for i in range(10, 40)]
    items = [(None, "alpha"), (1, "beta"), (1, "GAMMA beta"), (2, None), (3, "")]
    check(spark, docs, items, 4)
    check(spark, docs, items, 100)


def test_empty_tables_and_other_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b", 3, "x")], "doc_id long, text string, key int, items string")
    items = spark.createDataFrame([("i", "a", 1)], "item_id string, text string, rank int")
    assert S.search(none, items).count() == 0
    assert S.search(some, items.limit(0)).count() == 0
    assert [r["item_id"] for r in S.search(some, items).collect()] == ["i"]
