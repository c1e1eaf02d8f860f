"""Suffix arrays and the removal of repeated strings against plain loops."""

import random
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cartwise.llm import suffix_dedup as S


@given(st.lists(st.integers(1, 3), max_size=60))
@settings(max_examples=300, deadline=None)
def test_suffix_array(symbols):
    text = [*symbols, 0]
    assert S.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_suffix_array_of_periods_and_increasing_runs():
    for symbols in ([1] * 50, [1, 2] * 30, [2, 1] * 30, [1, 1, 2] * 20, list(range(1, 40)) * 3, [3, 2, 1] * 9 + [3, 2]):
        text = [*symbols, 0]
        assert S.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def rows_of(seed, n=60):
    r = random.Random(seed)
    passage = ["".join(r.choice("abcdé ") for _ in range(r.randint(20, 130))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [r.choice([r.choice(passage), "".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 60))), "x" * r.randint(0, 70)])
                 for _ in range(r.randint(0, 5))]
        rows.append((i, "".join(parts)))
    long = "".join(r.choice("abcdefgh") for _ in range(500))
    near = [(1000 + i, long[:7 * i] + "Z" + long[7 * i + 1:]) for i in range(20)]
    return rows + near + [(n, None), (n + 1, ""), (n + 2, rows[5][1]), (5, rows[5][1]), (None, long), (5, "same id")]


@pytest.mark.parametrize("seed, most", [(1, 4096), (2, 1), (3, 3)])
def test_matches_plain_loops(spark, seed, most):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in S.digest(S.dedup_strings(df, width=40, most=most)).collect()]
    assert sorted(got, key=str) == sorted(S.brute_force(rows, 40), key=str)


def test_long_texts_in_pieces(spark, monkeypatch):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghij") for _ in range(8)) for _ in range(3000)]
    text = " ".join(words)
    rows = [(1, text), (2, text[1000:9000] + "tail"), (3, "head" + text[20_000:]), (4, "a" * 3000), (5, "ab" * 900)]
    monkeypatch.setattr(S, "PIECE", 2000)
    got = []
    for d, t in rows:  # pieces give the same starts as the whole
        data = np.frombuffer(t.encode(), np.uint8)
        whole = S.segments(data, np.array([0, len(data)]), 40, 10)
        got.append(int(whole[3].sum()))
        assert got[-1] == len(data) - 39
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = [tuple(r) for r in S.digest(S.dedup_strings(df, width=40)).collect()]
    assert sorted(out) == sorted(S.brute_force(rows, 40))


def test_production_width(spark):
    r = random.Random(7)
    long = "".join(r.choice("abcdefgh ") for _ in range(3000))
    rows = [(1, long), (2, "x" + long[100:499]), (3, "y" + long[700:1100] + "y"), (4, long[:2000] + "!" + long[2001:]), (5, "=" * 900)]
    out = [tuple(r) for r in S.digest(S.dedup_strings(spark.createDataFrame(rows, "doc_id long, text string"))).collect()]
    assert sorted(out) == sorted(S.brute_force(rows, 400))


def test_empty_and_clashing_columns(spark):
    assert S.dedup_strings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a" * 50, 3, 4, 5)], "doc_id long, text string, key int, n_spans int, anchor int")
    row = S.dedup_strings(df, width=40).first()
    assert (row["key"], row["n_spans"], row["anchor"], row["kept"]) == (3, 1, 5, b"")


def test_strings_to_compare_are_held_one_place_at_a_time():
    r = random.Random(3)
    base = bytes(r.choice(b"abcdefgh") for _ in range(699))
    rows = []
    for i in range(400):  # near copies: each pair of them shares some strings
        at = r.randrange(699)
        text = base[:at] + b"%c" % (65 + i % 50) + base[at + 1:]
        rows.append({"anchor": i % 2, "print": i, "n": 300, "at": 300, "bytes": text})
    rows.sort(key=lambda x: (x["anchor"], x["print"]))
    times = {}
    for x in rows:
        for a in range(300):
            k = (x["anchor"], a, x["bytes"][a:a + 400])
            times[k] = times.get(k, 0) + 1
    want = [[times[x["anchor"], a, x["bytes"][a:a + 400]] > 1 for a in range(300)] for x in rows]
    del times
    tracemalloc.start()
    got = S.resolve(rows, 400, 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [g.tolist() for g in got] == want
    assert peak < 16 << 20  # 400 strings of 400 bytes, not 300 times as many
