"""Substring deduplication by Rabin-Karp hashes of all token windows.

Scan tasks hash every window of ``width`` tokens and deal the hashes, packed by
document, over buckets by their leading bits; each bucket is sorted and gives,
for every document, the hashes that also start in a smaller ``doc_id``.

A window that ``COMMON`` or more documents of one scan round share is sent to
its bucket only once, with its smallest document.  What its other holders have is
set aside with the round; the round's different common windows meet the buckets'
answers in a join, and the holders are told by round.  So a window that a large
part of all documents hold makes a row for each round, not for each document.
The hashes of each document then mark its windows; overlapping windows merge into
maximal intervals, which are removed.

Hashes have 64 bits; among n different windows about n * n / 2**65 pairs share
one, and then one of the two is taken for a repeat of the other."""

from __future__ import annotations

import hashlib
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwise.llm import bytetext as B
from cartwise.llm.common import materialize, small_batches, text_bytes

#: A window in so many documents of one round is common.
COMMON = 16
#: Bytes of text in one round of a scan task, and behind one of 64 buckets.
ROUND_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
PAIRS, LEAST, ASIDE = 0, 1, 2
DEALT = "bucket long, lead int, kind int, docs binary, sizes binary, hashes binary"


def windows(texts: B.Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows within one text, and the first word of each."""
    texts.words(B.NON_SPACE)
    h = B.rolling(texts.hashes(), width)
    at = np.flatnonzero(texts.doc[:len(h)] == texts.doc[width - 1:]) if len(h) else np.zeros(0, np.int64)
    return h[at], at


def pack(h: np.ndarray) -> bytes:
    """64-bit hashes without their leading byte, low parts first."""
    parts = ((0, 0xFFFFFFFF, "<u4"), (32, 0xFFFF, "<u2"), (48, 0xFF, "u1"))
    return b"".join(((h >> np.uint64(s)) & np.uint64(m)).astype(t).tobytes() for s, m, t in parts)


def unpack(packed: bytes, lead: int) -> np.ndarray:
    n = len(packed) // 7
    low, mid, high = (np.frombuffer(packed, t, n, at).astype(np.uint64)
                      for t, at in (("<u4", 0), ("<u2", 4 * n), ("u1", 6 * n)))
    return low | (mid << np.uint64(32)) | (high << np.uint64(48)) | (np.uint64(lead) << np.uint64(56))


def by_document(h: np.ndarray, doc: np.ndarray) -> tuple[bytes, bytes, np.ndarray]:
    """Documents (as steps), their numbers of hashes, and the hashes in that order."""
    order = np.argsort(doc, kind="stable")
    ids, n = np.unique(doc, return_counts=True)
    return np.diff(ids, prepend=0).astype("<i8").tobytes(), n.astype("<u4").tobytes(), h[order]


def _emit(h: np.ndarray, doc: np.ndarray, fine: int, at_round: int):
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    new = np.append(True, h[1:] != h[:-1])
    one = new.copy()
    one[1:] |= doc[1:] != doc[:-1]
    h, doc, new = h[one], doc[one], new[one]
    runs = np.flatnonzero(new)
    sizes = np.diff(np.append(runs, len(h)))
    big = sizes >= COMMON
    common = np.repeat(big, sizes)
    rows: list[tuple] = []
    if big.any():
        docs, n, found = by_document(h[common], doc[common])
        rows.append((-1 - at_round, 0, ASIDE, docs, n, found.astype("<u8").tobytes()))
    for kind, hashes, holders in ((PAIRS, h[~common], doc[~common]), (LEAST, h[runs][big], doc[runs][big])):
        # in order of hash already: a slice for each leading byte
        lead = (hashes >> np.uint64(56)).astype(np.int64)
        part = (hashes % np.uint64(fine)).astype(np.int64)
        for b in np.unique(lead):
            own = slice(*np.searchsorted(lead, [b, b + 1]))
            for f in range(fine):
                at = np.flatnonzero(part[own] == f) + own.start if fine > 1 else own
                if fine == 1 or len(at):
                    docs, n, found = by_document(hashes[at], holders[at])
                    rows.append(((int(b) >> 2) * fine + f, int(b), kind, docs, n, pack(found)))
    for at in range(0, len(rows), 64):
        part_rows = list(zip(*rows[at:at + 64]))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
            part_rows, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
            ["bucket", "lead", "kind", "docs", "sizes", "hashes"])


def _deal(width: int, fine: int):
    def deal(batches):
        h, doc, held = [], [], 0
        at_round = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, texts in B.text_chunks(batch):
                found, at = windows(texts, width)
                if len(found):
                    h.append(found)
                    doc.append(B.names_of(part.column("doc_id"))[texts.doc[at]])
                held += len(texts.data)
                if held >= ROUND_BYTES and h:
                    yield from _emit(np.concatenate(h), np.concatenate(doc), fine, at_round)
                    h, doc, held, at_round = [], [], 0, at_round + 1
        if h:
            yield from _emit(np.concatenate(h), np.concatenate(doc), fine, at_round)
    return deal


def _pairs(rows: pd.DataFrame) -> np.ndarray:
    return np.concatenate([np.repeat(np.cumsum(np.frombuffer(d, "<i8")), np.frombuffer(n, "<u4"))
                           for d, n in zip(rows["docs"], rows["sizes"])])


def _split(h: np.ndarray, doc: np.ndarray, kind: int) -> pd.DataFrame:
    """One row (kind, doc_id, packed hashes) for each document."""
    order = np.argsort(doc, kind="stable")
    ids, at = np.unique(doc[order], return_index=True)
    held = [x.astype("<i8").tobytes() for x in np.split(h[order], at[1:])] if len(ids) else []
    return pd.DataFrame({"kind": np.full(len(ids), kind, np.int32), "doc_id": ids.astype(np.int64), "hashes": held})


def _answer(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
    """The repeats of a bucket by document; the smallest document of each common
    window (by document too); what a round has set aside, as it is."""
    if key[0] < 0:
        return rows.assign(doc_id=-1 - key[0])[["kind", "doc_id", "docs", "sizes", "hashes"]]
    out = []
    for lead, own in rows.groupby("lead"):
        kinds = own["kind"].to_numpy()
        h = np.concatenate([unpack(x, lead) for x in own["hashes"]])
        common = np.unique(np.concatenate([unpack(x, lead) for x in own["hashes"][kinds == LEAST]] or [h[:0]]))
        doc = _pairs(own)
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        least = np.repeat(doc[first], np.diff(np.append(first, len(h))))
        again = doc > least
        out.append((h[again], doc[again], h[first][np.isin(h[first], common)], doc[first][np.isin(h[first], common)]))
    h, doc, common, least = (np.concatenate(x) for x in zip(*out))
    one = np.lexsort((h, doc))
    h, doc = h[one], doc[one]
    return pd.concat([_split(h, doc, PAIRS), _split(common, least, LEAST)]).assign(docs=None, sizes=None)[
        ["kind", "doc_id", "docs", "sizes", "hashes"]]


def _told(key: tuple[Any, ...], rounds: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """For the documents of a round, their common windows held by a smaller id."""
    if not len(rounds) or not len(known):
        return _split(np.zeros(0, np.int64), np.zeros(0, np.int64), PAIRS)[["doc_id", "hashes"]]
    h, doc = np.frombuffer(rounds["hashes"].iloc[0], "<i8"), _pairs(rounds)
    known = known.sort_values("hash")
    names, least = known["hash"].to_numpy(), known["least"].to_numpy()
    again = doc > least[np.searchsorted(names, h)]
    return _split(h[again], doc[again], PAIRS)[["doc_id", "hashes"]]


def _longs(batches):
    """Unpack (doc_id, hashes) to rows (doc_id, hash), different ones."""
    for batch in batches:
        held = [np.unique(np.frombuffer(x, "<i8")) for x in batch.column("hashes").to_pylist()]
        for at in range(0, len(held), 16):
            own = held[at:at + 16]
            ids = np.repeat(B.names_of(batch.column("doc_id"))[at:at + 16], [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(own), pa.int64())],
                                             ["doc_id", "hash"])


def repeated_windows(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, hashes): hashes of the windows of each document that also start in
    a document with a smaller id, as a list of packed arrays."""
    fine = max(1, -(-text_bytes(docs) // (64 * BUCKET_BYTES)))
    answers = materialize(
        docs.select("doc_id", "text").mapInArrow(B.frugal(_deal(width, fine)), DEALT)
        .groupBy("bucket").applyInPandas(_answer, "kind int, doc_id long, docs binary, sizes binary, hashes binary"), "windows")
    cold = answers.where(F.col("kind") == PAIRS).select("doc_id", "hashes")
    aside = answers.where(F.col("kind") == ASIDE).withColumnRenamed("doc_id", "round")
    least, wanted = (answers.where(F.col("kind") == kind).select("doc_id", "hashes").mapInArrow(
        _longs, "doc_id long, hash long").withColumnRenamed("doc_id", name)
        for kind, name in ((LEAST, "least"), (ASIDE, "round")))
    hot = (aside.select("round", "docs", "sizes", "hashes").groupBy("round")
           .cogroup(wanted.join(least, "hash").groupBy("round")).applyInPandas(_told, "doc_id long, hashes binary"))
    return cold.union(hot).groupBy("doc_id").agg(F.collect_list("hashes").alias("hashes"))


def _remove(width: int):
    def remove(batches):
        for batch in batches:
            for part, texts in B.text_chunks(batch):
                h, at = windows(texts, width)
                cuts = np.searchsorted(at, texts.first)
                told = part.column("__hashes").to_pylist()
                kept, n_words, n_removed = [], [], []
                valid = part.column("text").is_valid().to_pylist()
                for i in range(len(texts)):
                    a, b = texts.first[i], texts.first[i + 1]
                    keep = np.ones(b - a, bool)
                    if told[i]:
                        known = np.concatenate([np.frombuffer(x, "<u8") for x in told[i]])
                        hit = at[cuts[i]:cuts[i + 1]][np.isin(h[cuts[i]:cuts[i + 1]], known)] - a
                        step = np.zeros(b - a + 1, np.int64)
                        np.add.at(step, hit, 1)
                        np.add.at(step, hit + width, -1)
                        keep = np.cumsum(step[:-1]) == 0
                    n_words.append(b - a)
                    n_removed.append(int((~keep).sum()))
                    words = texts.data[texts.offsets[i]:texts.offsets[i + 1]].tobytes().split()
                    kept.append(" ".join(w.decode("utf-8", "replace") for w, k in zip(words, keep) if k)
                                if valid[i] else None)
                names = [n for n in part.schema.names if n != "__hashes"]
                columns = [pa.array(kept, pa.string()) if n == "text" else part.column(n) for n in names]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())],
                    [*names, "n_words", "n_removed"])
    return remove


def dedup_substrings(docs: DataFrame, width: int = 13) -> DataFrame:
    """Remove token windows that repeat from documents of smaller id.

    Tokens are runs of anything but [\\x20\\x09-\\x0D].  Each token covered by a
    window of ``width`` consecutive tokens whose sequence also starts in a
    document with a smaller ``doc_id`` goes; windows are judged on the input.

    Returns all columns of ``docs``; ``text`` holds the kept tokens joined by one
    space, ``n_words`` (before) and ``n_removed`` are added (input columns of
    these names are replaced).  A null text has no tokens and stays null, an
    empty text stays empty.  Rows that share a ``doc_id`` don't count as repeats
    of each other; rows with a null ``doc_id`` lose nothing and count for
    nothing.  An empty table gives an empty table."""
    small_batches(docs.sparkSession)
    docs = docs.drop("n_words", "n_removed", "__hashes")
    found = repeated_windows(docs.where(F.col("doc_id").isNotNull()), width)
    out = T.StructType([*(f if f.name != "text" else T.StructField("text", T.StringType()) for f in docs.schema),
                        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    wide = docs.join(found.select("doc_id", F.col("hashes").alias("__hashes")), "doc_id", "left").select(
        *docs.columns, "__hashes")
    return wide.mapInArrow(B.frugal(_remove(width)), out)


def digest(docs: DataFrame) -> DataFrame:
    """What query op10 returns."""
    return docs.select("doc_id", "n_words", "n_removed",
                       F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], width: int = 13) -> dict[int, tuple]:
    """The same result by plain loops, for tests."""
    words = {d: (t or "").encode().split() for d, t in rows}
    least: dict[tuple, int] = {}
    for d, w in words.items():
        for i in range(len(w) - width + 1):
            key = tuple(w[i:i + width])
            least[key] = min(least.get(key, d), d)
    out = {}
    for d, w in words.items():
        gone = {j for i in range(len(w) - width + 1) if least[tuple(w[i:i + width])] < d for j in range(i, i + width)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out
