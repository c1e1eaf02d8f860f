"""FM-index decontamination against brute force."""

import random

import numpy as np
import pytest

from cartwise.llm import decontamination as D


def data(seed):
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(12)] + ["É", "ça", "The", "x9"]
    items = [(i, r.choice([" ", ", ", "-"]).join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 3, 9, 10, 11, 30]))))
             for i in range(25)] + [(100, None), (None, "w1 w2"), (101, items_text := "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (102, items_text)]
    docs = []
    for d in range(60):
        parts = []
        for _ in range(r.randint(0, 8)):
            text = r.choice(items)[1] or ""
            words = text.split(" ")
            a = r.randint(0, len(words))
            parts.append(r.choice([text, " ".join(words[a:a + 12]), "other words here", text.upper(), r.choice(vocabulary)]))
        docs.append((d, "\n".join(parts)))
    return docs + [(900, None), (901, ""), (902, "!!"), (903, items_text), (904, items_text)], items


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    docs, items = data(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as spans", "'x' as n_hit").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in D.digest(D.find_contamination(df, bench, 10)).collect()}
    assert got == D.brute_force(docs, items)


def test_in_blocks(spark, monkeypatch):
    docs, items = data(3)
    monkeypatch.setattr(D, "BLOCK_WORDS", 200)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(list(D.blocks(bench, 10))) > 2
    got = {r[0]: tuple(r)[1:] for r in D.digest(D.find_contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), bench, 10)).collect()}
    assert got == D.brute_force(docs, items)


def test_null_and_shared_ids_in_blocks(spark, monkeypatch):
    """The same rows as with one block, also where doc_ids are null, shared or repeated."""
    docs, items = data(4)
    docs = [(None if d % 3 == 0 else d % 5, text) for d, text in docs] + docs[:5] + docs[:5]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")

    def results():
        return (sorted(map(repr, D.digest(D.find_contamination(df, bench, 10)).collect())),
                sorted(map(repr, D.remove_contamination(df, bench, 10).collect())))
    one = results()
    monkeypatch.setattr(D, "BLOCK_WORDS", 60)
    assert len(list(D.blocks(bench, 10))) > 2
    assert results() == one


def test_removal(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    df = spark.createDataFrame([(1, "Start, A b c-d e f g h i J! end"), (2, "clean é"), (3, None), (3, "a b")],
                               "doc_id long, text string").selectExpr("*", "7 as n_words", "8 as n_chars")
    got = {(r["doc_id"], r["text"]): r for r in D.remove_contamination(df, bench, 10).collect()}
    assert set(got) == {(1, "Start, ! end"), (2, "clean é"), (3, None), (3, "a b")}
    assert got[1, "Start, ! end"]["n_chars"] == 8 and got[1, "Start, ! end"]["n_words"] == 7


def test_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert D.digest(D.find_contamination(docs, none)).first()["contaminated"] is False
    assert D.find_contamination(docs.limit(0), none).count() == 0


def test_index_finds_all_phrases():
    g = np.random.default_rng(5)
    text = g.integers(0, 4, 3000)
    index = D.FMIndex(text, 4)
    phrases = g.integers(0, 4, (200, 5))
    low, high = index.search(phrases)
    grams = np.lib.stride_tricks.sliding_window_view(text, 5)
    for p, a, b in zip(phrases, low, high):
        assert sorted(index.locate(np.arange(a, b))) == np.flatnonzero((grams == p).all(axis=1)).tolist()
