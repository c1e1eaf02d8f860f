"""Licence scan with a positional rare-token index.

The words of all licence templates are counted over all documents; their inverse
document frequencies rank them.  Each template posts its rarest words with their
positions, so many that a passage which covers enough of the template must hold one
of them in its place.  In a file every occurrence of a posted word proposes a
(template, start): its position less the posted one.  All starts are checked: the
template's words that stand at their places are counted, and one of its mandatory
key phrases must stand within its reach."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwise.llm import bytetext as B
from cartwise.llm.common import small_batches

#: The phrases that make a base label.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Passages by which licences are known; "|" stands between the
#: passage and its key phrases, one of which is mandatory.
TEMPLATES = {
    "mit": ["released under the mit license | mit license",
            "permission is hereby granted free of charge to any person obtaining a copy of this software "
            "| permission is hereby granted"],
    "apache": ["licensed under the apache license version 2 0 | apache license"],
    "gpl": ["this work is licensed under the gnu general public license version 3 "
            "| gnu general public license | general public license",
            "this program is free software you can redistribute it and or modify it under the terms of the "
            "gnu general public license as published by the free software foundation | general public license"],
    "lgpl": ["gnu lesser general public license | lesser general public license"],
    "agpl": ["gnu affero general public license | affero general public license"],
    "cc-by": ["licensed under cc by 4 0 | cc by 4 0", "creative commons attribution 4 0 international license "
              "| creative commons attribution 4 0"],
    "cc-by-nc": ["licensed under cc by nc 4 0 | cc by nc",
                 "creative commons attribution noncommercial 4 0 international license | attribution noncommercial 4 0"],
    "cc-by-sa": ["licensed under cc by sa 4 0 | cc by sa", "creative commons attribution sharealike 4 0 "
                 "international license | attribution sharealike 4 0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted "
            "| redistribution and use in source and binary forms"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2 0 | mozilla public license"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
            "| permission to use copy modify and or distribute"],
    "unlicense": ["this is free and unencumbered software released into the public domain | unencumbered software"],
}
#: Share of a template's words that must stand at their places.
COVERAGE = 0.6


class Index:
    """Templates in numbers of their vocabulary (from 1), and phrases."""

    def __init__(self) -> None:
        self.passages = [(label, passage.split("|")[0].split(), [p.split() for p in passage.split("|")[1:]])
                         for label, passages in TEMPLATES.items() for passage in passages]
        words = {w for _, own, phrases in self.passages for w in [*own, *(x for p in phrases for x in p)]}
        words |= {w for p in BASE for w in p.split()}
        self.words = sorted(words)
        joined = " ".join(self.words).encode()
        texts = B.Texts(np.frombuffer(joined, np.uint8), np.array([0, len(joined)])).words(B.ALNUM)
        order = np.argsort(texts.hashes())
        self.hashes, self.number = texts.hashes()[order], order + 1
        at = {w: i + 1 for i, w in enumerate(self.words)}
        self.templates = [(label, np.array([at[w] for w in own]), [np.array([at[w] for w in p]) for p in phrases])
                          for label, own, phrases in self.passages]
        self.base = [(label, np.array([at[w] for w in p.split()])) for p, label in BASE.items()]

    def numbers(self, texts: B.Texts) -> np.ndarray:
        """The number of each word; 0 is not a licence word."""
        h = texts.words(B.ALNUM, lower=True).hashes()
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.number[at], 0)


def stands(phrase: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Where ``phrase`` starts in ``words``."""
    n = len(words) - len(phrase) + 1
    at = np.flatnonzero(words[:max(n, 0)] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[words[at + k] == phrase[k]]
    return at


def detect(words: np.ndarray, first: np.ndarray, index: Index, rarity: np.ndarray) -> list[dict[str, float]]:
    """For each text labels with the best share of a template's words, weighted by
    rarity; text ``d`` has the words from ``first[d]`` to ``first[d + 1]``."""
    found: list[dict[str, float]] = [{} for _ in first[1:]]
    doc = np.repeat(np.arange(len(found)), np.diff(first))
    held = np.flatnonzero(words)
    held = held[np.argsort(words[held], kind="stable")]
    begins = np.searchsorted(words[held], np.arange(len(index.words) + 2))
    for label, own, phrases in index.templates:
        least = next(n for n in range(len(own) + 1) if n / len(own) >= COVERAGE)
        # at most len(own) - least words are not at their places
        posted = np.argsort(-rarity[own], kind="stable")[:len(own) - least + 1]
        at = [held[begins[own[p]]:begins[own[p] + 1]] for p in posted]
        start = np.concatenate([a - p for a, p in zip(at, posted)])
        span = len(words) + len(own)
        key = np.unique(doc[np.concatenate(at)] * span + start + len(own))
        d, start = key // span, key % span - len(own)
        n = np.zeros(len(key), np.int64)
        for k, w in enumerate(own):
            place = start + k
            inside = (place >= first[d]) & (place < first[d + 1])
            n[inside] += words[place[inside]] == w
        for d, start in zip(d[n >= least].tolist(), start[n >= least].tolist()):
            text, start = words[first[d]:first[d + 1]], start - int(first[d])
            places = start + np.arange(len(own))
            inside = (places >= 0) & (places < len(text))
            same = np.zeros(len(own), bool)
            same[inside] = text[places[inside]] == own[inside]
            share = float((rarity[own] * same).sum() / rarity[own].sum())
            if share <= found[d].get(label, 0):
                continue
            near = text[max(0, start):max(0, start) + len(own) + 1]
            if any(len(stands(p, near)) for p in phrases):
                found[d][label] = share
    return found


ADDED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
                      T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
                      T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
                      T.StructField("score", T.DoubleType())])


def _rarities(size: int):
    """Per task: how many documents hold each licence word, and how many there are."""
    def run(batches):
        index = Index()
        held, n = np.zeros(size, np.int64), 0
        for batch in batches:
            for part, texts in B.text_chunks(batch):
                words = index.numbers(texts)
                some = words > 0
                held += np.bincount(np.unique(texts.doc[some] * size + words[some]) % size, minlength=size)
                n += len(texts)
        held[0] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(held)], ["word", "n"])
    return run


def _scan(shared):
    def run(batches):
        index, rarity = Index(), shared.value
        for batch in batches:
            for part, texts in B.text_chunks(batch):
                every = index.numbers(texts)
                out: list[list] = [[] for _ in ADDED]
                for a, b, found in zip(texts.first[:-1], texts.first[1:], detect(every, texts.first, index, rarity)):
                    words = every[a:b]
                    base = {label: at for label, p in index.base if len(at := stands(p, words))} if (words > 0).any() else {}
                    places = np.concatenate([*base.values(), np.zeros(0, np.int64)])
                    row = (len(words), len(places), int(places.min()) if len(places) else None,
                           int(places.max()) if len(places) else None, ",".join(sorted(base)),
                           ",".join(sorted({*base, *found})), 1.0 if base else max(found.values(), default=0.0))
                    for column, x in zip(out, row):
                        column.append(x)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, t) for x, t in zip(out, types))],
                                                 [*part.schema.names, *ADDED.names])
    return run


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Find licences in ``docs(doc_id, text, ...)``.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased.
    Returns all columns of ``docs`` with these added (input columns of these names
    are replaced): n_words; n_base, first_word and last_word, the places where
    ``BASE`` phrases stand consecutively; base_labels; labels, with those of
    verified templates; score, 1 with a base label, else the best template's
    share.  Null and empty texts have no words and score 0; repeated rows are
    scanned alike; an empty table gives an empty table."""
    spark = docs.sparkSession
    small_batches(spark)
    index = Index()
    size = len(index.words) + 1
    held = np.zeros(size)
    # a row for each licence word
    for row in docs.select("text").mapInArrow(B.frugal(_rarities(size)), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        held[row["word"]] = row["n"]
    rarity = np.log((held[0] + 1) / (held + 0.5))
    rarity = np.maximum(rarity, 1e-3)
    rarity[0] = 0
    docs = docs.drop(*ADDED.names)
    return docs.mapInArrow(B.frugal(_scan(spark.sparkContext.broadcast(rarity))), T.StructType([*docs.schema, *ADDED]))


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, tuple]:
    """n_words, n_base, first_word, last_word, base_labels by plain loops."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    out = {}
    for d, text in rows:
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        hits = [(i, label) for p, label in BASE.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        out[d] = (len(w), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None),
                  ",".join(sorted({x for _, x in hits})))
    return out
