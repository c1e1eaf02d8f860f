"""The pipeline against the operators' brute-force versions, stage by stage."""

import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from cartwise.llm import decontamination, line_dedup, simhash
from cartwise.llm.common import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows that each stage takes and returns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(1).selectExpr("doc_id + 5000 as doc_id", "cast(null as string) as text", "lang", "source", "n_chars")
    docs = docs.union(extra)
    out = [docs.collect()]
    for name, stage in P.STAGES:
        docs = materialize(stage(spark, docs, SF), "test")
        if name != "best_fit_packing":
            assert docs.columns == P.COLUMNS
        out.append(docs.collect())
    return out


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def test_toxicity_keeps_rows_whole(stages):
    before, after = by_id(stages[0]), by_id(stages[1])
    assert set(after) <= set(before) and all(before[i]["text"] == after[i]["text"] for i in after)
    assert len(after) > 0.8 * len(before)


def test_line_dedup(stages):
    before, after = stages[1], by_id(stages[2])
    want = line_dedup.brute_force([(r["doc_id"], r["text"]) for r in before])
    import hashlib
    assert {i: hashlib.sha256((r["text"] or "").encode()).hexdigest() for i, r in after.items()} == {
        i: x[2] for i, x in want.items()}


def test_near_duplicates(stages):
    before, after = stages[2], by_id(stages[3])
    want = simhash.brute_force([(r["doc_id"], r["text"]) for r in before])
    assert set(after) == {c for _, c in want.values()}


def test_decontamination(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    before, after = by_id(stages[3]), by_id(stages[4])
    found = decontamination.brute_force([(i, r["text"]) for i, r in before.items()], items)
    assert set(before) == set(after) and any(x[-1] for x in found.values())
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, (n_words, n_hit, *_, hit) in found.items():
        if hit:
            left = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), after[i]["text"]))
            assert len(left) == n_words - n_hit
        else:
            assert after[i]["text"] == before[i]["text"]


def test_packing(stages):
    before, pieces = by_id(stages[4]), stages[5]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = defaultdict(int)
    for p in pieces:
        lengths[p["doc_id"]] += p["length"]
    want = {}
    for i, r in before.items():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        want[i] = len(ids)
        if len(ids) <= 2048:
            crc = zlib.crc32(np.array(ids, "<u4").tobytes())
            assert [p["ids_crc32"] for p in pieces if p["doc_id"] == i] == [crc]
    assert lengths == want


def test_whole_run_gives_the_same(spark, stages):
    got = {tuple(r)[:5] for r in P.run(spark, SF).collect()}
    assert {tuple(r)[:5] for r in stages[5] if r["doc_id"] < 5000} == got
