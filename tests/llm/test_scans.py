"""Toxicity on held-out labels, and licence scans against brute force."""

import random
import zlib

import numpy as np

from cartwise.llm import bytetext, license_scan, toxicity


def corpus(n=1500, seed=1):
    r = random.Random(seed)
    plain = ["w%d" % i for i in range(400)]
    bad = ["b%d" % i for i in range(8)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [r.choice(bad) if toxic and r.random() < 0.1 else r.choice(plain) for _ in range(r.randint(20, 80))]
        docs.append((i, " ".join(words)))
        if r.random() < 0.8:
            labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs + [(9000, None), (9001, ""), (None, "b1 b2 b3")], "doc_id long, text string")
    df = df.selectExpr("*", "5 as score", "'x' as toxic")
    lab = spark.createDataFrame(labels + [(None, 1), (9000, None), (3, 7), labels[0]], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(df, lab).collect()}
    assert len(got) == len(docs) + 3
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i in held) and not got[None]["held_out"]
    assert np.mean([got[i]["predicted"] == (i % 4 == 0) for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert got[9000]["score"] == got[9001]["score"] and got[9000]["toxic"] == "x" and got[None]["predicted"] == 1


def test_held_out_labels_are_not_read(spark):
    docs, labels = corpus(400)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.score_toxicity(
        df, spark.createDataFrame(x, "doc_id long, toxic int")).collect()} for x in (labels, turned))
    assert a == b


def test_counts_do_not_depend_on_the_split(spark):
    docs, labels = corpus(300)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.score_toxicity(x, lab).collect()} for x in (df.coalesce(1), df.repartition(7)))
    assert a == b


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_toxicity(df, none).first()["score"] == 0
    assert toxicity.score_toxicity(df.limit(0), none).count() == 0


def license_rows(seed=1):
    r = random.Random(seed)
    parts = ["Released under the MIT License.", "mit-license", "MIT", "license", "Licensed under the Apache License, Version 2.0.",
             "This work is licensed under the GNU General Public License, version 3.", "general  public\nlicense", "other words é",
             "Licensed under CC BY-NC 4.0.", "apache license apache license", "mit mit license"]
    rows = [(i, " ".join(r.choice(parts) for _ in range(r.randint(0, 6)))) for i in range(80)]
    return rows + [(100, None), (101, ""), (102, "--"), (103, rows[1][1])]


def test_base_matches_brute_force(spark):
    rows = license_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as labels")
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels"))
           for r in license_scan.scan_licenses(df).collect()}
    assert got == license_scan.brute_force(rows)


def test_templates_need_their_key_phrase(spark):
    rows = [(1, "x Licensed under CC BY-NC 4.0. y"), (2, "licensed under cc by 4 0"), (3, "licensed under cc by zz 4 0"),
            (4, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
            (5, "permission to any person of charge"), (6, "the the the license and of software"),
            (7, "Subject to the terms of the Mozilla Public License, v. 2.0 this")]
    got = {r["doc_id"]: (r["labels"], r["base_labels"], r["score"])
           for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i][0] for i in range(1, 8)] == ["cc-by-nc", "cc-by", "", "mit", "", "", "mpl"]
    assert got[4][1] == "" and got[4][2] > 0.9 and got[6][2] == 0


def test_every_template_is_found(spark):
    rows, want = [], {}
    for label, passages in license_scan.TEMPLATES.items():
        for passage in passages:
            want[len(rows)] = label
            rows.append((len(rows), "some words before. " + passage.split("|")[0].upper() + " and after"))
    got = {r["doc_id"]: r["labels"].split(",") for r in license_scan.scan_licenses(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in got[i] for i, label in want.items())


def test_empty(spark):
    assert license_scan.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_share_no_counts(spark):
    """Words whose hashes agree in their first 21 bits are counted apart."""
    names = ["v%d" % i for i in range(20000)]
    joined = " ".join(names).encode()
    texts = bytetext.Texts(np.frombuffer(joined, np.uint8), np.array([0, len(joined)])).words(bytetext.ALNUM)
    same: dict = {}
    for name, h in zip(names, texts.hashes() >> np.uint64(43)):
        same.setdefault(h, []).append(name)
    plain, bad = zip(*[own[:2] for own in same.values() if len(own) > 1][:20])
    r = random.Random(2)
    docs = [(i, " ".join(r.choice(bad) if i % 4 == 0 and r.random() < 0.2 else r.choice(plain) for _ in range(40))) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in docs], "doc_id long, toxic int")
    got = toxicity.score_toxicity(df, lab).where("held_out").collect()
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in got]) > 0.97


def test_copies_are_one_context(spark):
    """A context of many copies counts once: their labels do not outweigh a class."""
    docs, labels = corpus(800)
    labels = [(i, int(i % 4 == 0)) for i, _ in docs]
    copied = " ".join("w%d" % i if i % 15 else "b%d" % (i // 15) for i in range(120))
    copies = [(i, copied) for i in range(5000, 7000)]
    df = spark.createDataFrame(docs + copies, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(i, 0) for i, _ in copies if zlib.crc32(str(i).encode()) % 5 in (1, 2, 3)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(df, lab).where("held_out and doc_id < 800 and doc_id % 4 = 0").collect()
    assert np.mean([r["predicted"] for r in got]) > 0.9


def test_small_differences_count(spark):
    """Words that toxic texts hold four times as often tell, though no word stands out."""
    r = random.Random(3)
    odd, plain = ["m%d" % i for i in range(40)], ["w%d" % i for i in range(40)]
    docs = [(i, " ".join(r.choice(odd) if r.random() < (0.8 if i % 2 else 0.2) else r.choice(plain) for _ in range(30)))
            for i in range(600)]
    lab = spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, toxic int")
    got = toxicity.score_toxicity(spark.createDataFrame(docs, "doc_id long, text string"), lab).where("held_out").collect()
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in got]) > 0.95


def test_several_licenses_in_a_file(spark):
    """Each licence of a file is found, however rare the words of another one are."""
    own = {label: passages[-1].split("|")[0] for label, passages in license_scan.TEMPLATES.items()}
    usual = [own[x] for x in ("cc-by", "mpl", "lgpl", "cc-by-sa")]
    rows = [(i, " filler ".join(reversed(x.split()))) for i, x in enumerate(usual * 20)]
    many = [(1000, " and also ".join(own.values())), (1001, " text ".join(reversed(own.values()))),
            (1002, own["unlicense"] + " " + own["bsd"] + " " + own["mpl"] + " x " + own["cc-by"])]
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in license_scan.scan_licenses(
        spark.createDataFrame(rows + many, "doc_id long, text string").repartition(3)).collect()}
    assert got[1000] >= set(own) and got[1001] >= set(own) and got[1002] >= {"unlicense", "bsd", "mpl", "cc-by"}


def test_detect_leaves_out_no_start():
    """The same as checking every start."""
    r, index = random.Random(4), license_scan.Index()
    words, first = [], [0]
    for _ in range(60):
        for _ in range(r.randint(0, 5)):
            own = r.choice(index.templates)[1].tolist()
            words += [w if r.random() < 0.8 else r.randint(0, len(index.words)) for w in own[r.randint(0, 3):]]
        first.append(len(words))
    words, first = np.array(words), np.array(first)
    rarity = np.array([0] + [r.random() + 0.1 for _ in index.words])
    want = []
    for a, b in zip(first[:-1], first[1:]):
        text, best = words[a:b].tolist(), {}
        for label, own, phrases in index.templates:
            for s in range(-len(own), len(text)):
                same = np.array([0 <= s + k < len(text) and text[s + k] == w for k, w in enumerate(own)])
                near = words[a:b][max(0, s):max(0, s) + len(own) + 1]
                if same.mean() >= license_scan.COVERAGE and any(len(license_scan.stands(p, near)) for p in phrases):
                    best[label] = max(best.get(label, 0), float((rarity[own] * same).sum() / rarity[own].sum()))
        want.append(best)
    assert license_scan.detect(words, first, index, rarity) == want and sum(map(len, want)) > 20


def test_contexts_match_brute_force(spark, monkeypatch):
    """Different contexts of each word, and of the unknown word, over many buckets and
    with words whose contexts are dealt over several of them."""
    monkeypatch.setattr(toxicity, "BUCKET_BYTES", 500)
    monkeypatch.setattr(toxicity, "PART", 40)
    docs, labels = corpus(300)
    docs += [(i, "w1 w2 new%d new%d W1" % (i % 7, i)) for i in range(1000, 1400)] + [(2000, None), (2001, ""), (None, "b1 x")]
    train = np.array([i for i, _ in labels if i % 3], np.int64), np.array([t for i, t in labels if i % 3], np.int64)
    pairs = {}
    kinds = dict(zip(*(x.tolist() for x in train)))
    known = {w for i, text in docs if i in kinds for w in (text or "").lower().split()}
    for i, text in docs:
        words = (text or "").lower().split()
        for before, word in zip(["", *words], words):
            pairs.setdefault(word if word in known else "", {}).setdefault(before, set()).add(kinds.get(i))
    want = {w: tuple(sum(k is None or k in c for c in found.values()) for k in (None, 0, 1)) for w, found in pairs.items()}
    monkeypatch.setattr(toxicity, "OFTEN", 2)
    names, counts = toxicity.count_contexts(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), train)
    order = sorted(known, key=lambda w: hash_of(w))
    assert [hash_of(w) for w in order] == names.tolist()
    assert [tuple(c) for c in counts.tolist()] == [want[w] for w in [*order, ""]]


def hash_of(word):
    texts = bytetext.Texts(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())]))
    return int(texts.words(bytetext.ALNUM).hashes()[0])


def test_packed_numbers_come_back():
    x = np.array([0, 1, 255, 256, 2**31, 2**40 - 1], np.uint64)
    assert toxicity.whole(toxicity.planes(x, 5), 5).tolist() == x.tolist()
    assert toxicity.different(np.array([9, 4, 10, 5, 4], np.uint64)).tolist() == [5, 11]
