"""Sequence packing and sharding: properties, and the tokenizer used directly."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cartwise.llm import packing, sharding

FILE = public_tokenizers.path("word_bpe_49k.json")


def texts(spark):
    found = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    return found + [None, "", " \n", "Don't stop-it, é É İSTANBUL Σας a b c\x1c d", "<|ENDOFTEXT|> <|endoftext|>x Y",
                    "word " * 5000, found[0], "x" * 300, "áb ́c 12.5%"]


def test_pieces_and_places(spark):
    rows = list(enumerate(texts(spark)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = packing.pack_documents(df, FILE, 2048, 0, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(FILE)
    want = {}
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            own = np.array(ids[at:at + 2048], "<u4")
            want[d, k] = (at, len(own), zlib.crc32(own.tobytes()))
            assert [r["ids"] for r in got if (r["doc_id"], r["piece"]) == (d, k)] == [own.tolist()]
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    assert len(got) == len(want)
    fill = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048
    least = -(-sum(fill.values()) // 2048)
    assert len(fill) <= least * 1.02 + 1


def brute_pack(lengths, capacity):
    """First-fit decreasing, piece by piece."""
    bins = []
    for n in sorted(lengths, reverse=True):
        for i, b in enumerate(bins):
            if b >= n:
                bins[i] -= n
                break
        else:
            bins.append(capacity - n)
    return len(bins)


@pytest.mark.parametrize("seed", range(12))
def test_plan_holds_every_piece(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 30, 100, 2048])
    lengths = [min(capacity, max(1, int(r.choice([r.random(), r.random() ** 3]) * capacity))) for _ in range(r.randint(0, 800))]
    bins = packing.plan(Counter(lengths), capacity)
    held = Counter()
    for n, gap, own in bins:
        assert n > 0 and sum(own) + gap == capacity and gap >= 0
        assert sum(x > capacity // 3 for x in own) <= 2
        for x in own:
            held[x] += n
    assert held == Counter(lengths)
    assert sum(n for n, _, _ in bins) <= brute_pack(lengths, capacity) * 1.03 + 1
    table = packing.places(bins)
    assert len({tuple(x) for x in table[:, :2].tolist()}) == len(table)


def test_pack_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(df, FILE).count() == 0
    df = spark.createDataFrame([(None, "a b", 1), (1, "a b", 2), (1, "a b", 2)], "doc_id long, text string, length int")
    got = packing.pack_documents(df, FILE).collect()
    assert len(got) == 3 and {r["length"] for r in got} == {3} and sorted(r["offset"] for r in got) == [0, 3, 6]


def test_tightest_bin():
    bins = sharding.Bins()
    r = random.Random(4)
    plain = []
    for i in range(500):
        key = (r.randint(1, 60), i)
        bins.insert(key)
        plain.append(key)
        if i % 3:
            size = r.randint(1, 70)
            want = min((k for k in plain if k[0] >= size), default=None)
            assert bins.take_tightest(size) == want
            if want:
                plain.remove(want)


def test_shards(spark):
    r = random.Random(1)
    words = ["x" * r.randint(0, 400) + str(i) for i in range(300)]
    rows = [(i, r.choice([r.choice(words), words[0], "é", None, ""])) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as size")
    got = sharding.shard_documents(df, 8).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    by_text, load, slots = {}, Counter(), {}
    for x in got:
        t = text[x["doc_id"]]
        assert x["size"] == len((t or "").encode()) + 1 and x["text_crc32"] == zlib.crc32((t or "").encode())
        assert by_text.setdefault(t, x["shard"]) == x["shard"] and x["law"] == "bytes" and x["grown_shard"] is None
        load[x["shard"]] += x["size"]
        slots.setdefault(x["shard"], []).append(x["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    group = Counter()
    for x in got:
        group[text[x["doc_id"]]] += x["size"]
    assert max(load.values()) <= max(max(group.values()), sum(load.values()) / 8 * 1.01)
    assert len(load) == 8


def test_lots_fill_shards_evenly(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GRAIN", 200)
    monkeypatch.setattr(sharding, "LOT_ROWS", 500)
    df = spark.range(5000).selectExpr("id as doc_id", "repeat('ab', cast(id % 89 as int)) || id as text")
    load = Counter()
    for x in sharding.shard_documents(df, 8).collect():
        load[x["shard"]] += x["size"]
    assert max(load.values()) <= 1.01 * sum(load.values()) / 8 and len(load) == 8


def test_shards_of_nothing(spark):
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ids_do_not_depend_on_what_a_worker_has_seen():
    """Random Unicode in two orders against the tokenizer."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        definition = f.read()
    plain = Tokenizer.from_str(definition)
    r = random.Random(11)
    pool = "abzAZ09\u00e9\u00c9\u00df\u0130\u0131\u017f\u0345\u0301\u03a9\u0416\u4e2d\U0001f5df\u200b\u00b5\u2126\u1e9e"
    words = ["".join(r.choice(pool) for _ in range(r.randint(1, 4))) for _ in range(1500)] + ["\U0001f5df", "I\u0307", "\u0130"]
    texts = words + [w + r.choice(["<", "?", ">", "!?", "'", ".", "(|)"]) for w in words]
    for order in (texts, texts[::-1]):
        encoder = packing.Encoder(definition)
        for at in range(0, len(order), 500):
            some = order[at:at + 500]
            ids, places = encoder.encode([t.encode() for t in some], 0)
            for i, t in enumerate(some):
                assert ids[places[i]:places[i + 1] - 1].tolist() == plain.encode(t, add_special_tokens=False).ids, t
