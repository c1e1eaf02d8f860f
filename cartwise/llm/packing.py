"""Packing of tokenised documents into sequences of fixed capacity.

Tokenising and cutting run in scan tasks.  The packing itself only depends on how
many pieces there are of each length, at most ``capacity`` numbers: from this
histogram the driver makes a plan of bin patterns (lengths, offsets, how many
bins), whose size is bounded by the capacity, not by the documents.  Pieces are
then numbered within their length in Spark and look their places up in the plan.

Large-item matching: pieces above a third of the capacity stand at most two in a
bin; in descending order each is paired with the largest other one that fits.
Smaller pieces follow in descending order, each into the tightest gap."""

from __future__ import annotations

import gc
import os
import zlib
from itertools import repeat
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.llm import bytetext as B
from cartwise.llm.common import batch_rows, gapless, materialize, small_batches

#: Different chunks whose ids a Python worker remembers.
REMEMBERED = 2_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Token ids of white-space-delimited chunks, remembered.

    Valid for tokenizers that never join across white space and lower-case their
    input; ASCII letters are lower-cased first, but not in a text that may hold a
    special token's string.  A chunk of Latin letters and a final run of ASCII
    marks is put together from both, and the letters go to the tokenizer's model at
    once, if that gives the tokenizer's own ids for ``PROBES``."""

    MARKS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
    PROBES = ("word", "thntblere", "\u00e9\u00e8\u00e7\u00e0", "\u00dfkeit", "a\u00f1o", "x", "stra\u00dfe")

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(definition)
        # the usual bytes-to-letters table of byte-level models
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.letters = dict(zip([*plain, *(b for b in range(256) if b not in plain)], map(chr, [*plain, *range(256, 324)])))
        self.runs: dict[bytes, list[int]] = {b"": []}
        self.direct = True
        ends = ("", ",", ".", "***", "!?", "'", "'.", "(|)")
        self.direct = all(self.word_ids(p.encode(), p) + self.run_ids(e.encode()) == self.ids_of([p + e])[0]
                          for p in self.PROBES for e in ends)
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.starts, self.sizes, self.ids = (np.zeros(0, t) for t in (np.int64, np.int64, np.uint32))

    def ids_of(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def run_ids(self, marks: bytes) -> list[int]:
        """Ids of a run of marks at the end of a chunk."""
        ids = self.runs.get(marks)
        if ids is None:
            if len(self.runs) > 10_000:
                self.runs = {b"": []}
            ids = self.runs[marks] = self.ids_of([marks.decode()])[0]
        return ids

    def latin(self, word: bytes) -> str | None:
        """A word of Latin letters in lower case as text, else None: marks that follow
        only such a word can't change its ids."""
        if word.isalpha():  # ASCII letters
            text = word.decode()
        else:
            text = word.decode("utf-8", "replace")
            if not text.isalpha() or max(text) >= "\u0250" or not is_normalized("NFC", text):
                return None
        return text if self.direct and text == text.lower() else None

    def word_ids(self, word: bytes, text: str) -> list[int]:
        """Ids of a word that has passed ``latin``."""
        if not text.isascii():
            text = word.decode("latin-1").translate(self.letters)
        return [t.id for t in self.tokenizer.model.tokenize(text)]

    def learn(self, chunks: list[bytes]) -> None:
        names, flat, sizes, others = [], [], [], []
        words: dict[bytes, list[int] | None] = {}  # those that stand before marks
        tokenize = self.tokenizer.model.tokenize
        for chunk in chunks:
            if self.direct and chunk.isalpha() and chunk.islower():  # ASCII letters
                ids = [t.id for t in tokenize(chunk.decode())]
            else:
                word = chunk.rstrip(self.MARKS)
                ids = words.get(word)
                if ids is None and word not in words:
                    at, text = self.known.get(word), self.latin(word)
                    ids = words[word] = (None if text is None else self.word_ids(word, text) if at is None else
                                         self.ids[self.starts[at]:self.starts[at] + self.sizes[at]].tolist())
                if ids is None or b"<|" in chunk:
                    others.append(chunk)
                    continue
                if len(word) < len(chunk):
                    ids = ids + self.run_ids(chunk[len(word):])
            names.append(chunk)
            sizes.append(len(ids))
            flat += ids
        for chunk, ids in zip(others, self.ids_of([c.decode("utf-8", "replace") for c in others])):
            names.append(chunk)
            sizes.append(len(ids))
            flat += ids
        at = len(self.starts)
        self.known.update(zip(names, range(at, at + len(names))))
        new = np.array(sizes, np.int64)
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(new) - new)
        self.sizes = np.append(self.sizes, new)
        self.ids = np.append(self.ids, np.array(flat, np.uint32))

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end_id``, and the places they start."""
        chunks: list[bytes] = []
        firsts = [0]
        for t in texts:
            chunks += (t if b"<|" in t else t.lower()).split()
            firsts.append(len(chunks))
        codes = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
        if len(missing := np.flatnonzero(codes < 0)):
            new = list(dict.fromkeys(chunks[i] for i in missing))
            if len(self.known) + len(new) > REMEMBERED:
                self.clear()
                new, missing = list(dict.fromkeys(chunks)), np.arange(len(chunks))
            self.learn(new)
            codes[missing] = [self.known[chunks[i]] for i in missing]
        sizes = self.sizes[codes]
        total = np.append(0, np.cumsum(sizes))
        # a place is left after each text for its end
        text = np.repeat(np.arange(len(texts)), np.diff(firsts))
        ids = np.full(total[-1] + len(texts), end_id, np.uint32)
        at = np.repeat(self.starts[codes] - total[:-1], sizes) + np.arange(total[-1])
        ids[np.arange(total[-1]) + np.repeat(text, sizes)] = self.ids[at]
        return ids, np.append(0, total[firsts[1:]] + np.arange(1, len(texts) + 1))


_encoders: dict[int, Encoder] = {}


def _pieces(definition, capacity: int, end_id: int, with_ids: bool):
    def run(batches):
        key = hash(definition.value)
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(definition.value)
        gc.disable()  # many small lists, none in a cycle: collections only cost time
        for batch in batches:
            for part, texts in B.text_chunks(batch):
                raw = [texts.data[a:b].tobytes() for a, b in zip(texts.offsets[:-1], texts.offsets[1:])]
                ids, at = _encoders[key].encode(raw, end_id)
                out: list[list] = [[], [], [], [], [], []]
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    for piece, start in enumerate(range(0, b - a, capacity)):
                        own = ids[a + start:min(b, a + start + capacity)].astype("<u4")
                        row = (doc_id, piece, start, len(own), zlib.crc32(own.tobytes()), own.tolist() if with_ids else None)
                        for column, x in zip(out, row):
                            column.append(x)
                columns = [pa.array(x, t) for x, t in zip(out, (
                    pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(columns[:5 + with_ids], names[:5 + with_ids])
        gc.enable()
    return run


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, list[int]]]:
    """Bins for ``counts`` pieces of each length: (number of bins, gap, lengths in
    the order of their offsets)."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    open_bins: list[list[tuple[int, list[int]]]] = [[] for _ in range(capacity + 1)]
    gaps = np.zeros(capacity + 1, bool)

    def put(gap: int, n: int, lengths: list[int]) -> None:
        open_bins[gap].append((n, lengths))
        gaps[gap] = True

    third = capacity // 3
    for large in range(capacity, third, -1):
        while left[large]:
            room = min(capacity - large, large)
            fits = np.flatnonzero(left[third + 1:room + 1]) + third + 1 if room > third else []
            if len(fits) and (fits[-1] != large or left[large] > 1):
                partner = int(fits[-1])
                n = int(left[large] // 2 if partner == large else min(left[large], left[partner]))
                put(capacity - large - partner, n, [large, partner])
                left[partner] -= n
            elif len(fits) > 1:  # one piece of this length is left; the next smaller partner
                partner, n = int(fits[-2]), 1
                put(capacity - large - partner, n, [large, partner])
                left[partner] -= n
            else:
                n = int(left[large])
                put(capacity - large, n, [large])
            left[large] -= n
    for small in range(third, 0, -1):
        n = int(left[small])
        while n:
            wide = np.flatnonzero(gaps[small:])
            if not len(wide):
                each = capacity // small
                if n >= each:
                    put(capacity - each * small, n // each, [small] * each)
                if n % each:
                    put(capacity - n % each * small, 1, [small] * (n % each))
                break
            gap = int(wide[0]) + small
            bins, lengths = open_bins[gap].pop()
            used = min(n, bins)
            if used < bins:
                open_bins[gap].append((bins - used, lengths))
            gaps[gap] = bool(open_bins[gap])
            put(gap - small, used, [*lengths, small])
            n -= used
    return [(n, gap, lengths) for gap, own in enumerate(open_bins) for n, lengths in own]


def places(bins: list[tuple[int, int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: the pieces of a
    length, numbered from the first rank, stand in consecutive sequences."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for n, _, lengths in bins:
        offset = 0
        for length in lengths:
            rows.append((length, used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + n
            offset += length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _place(table):
    def run(batches):
        rows = table.value
        keys = (rows[:, 0] << 44) + rows[:, 1]
        for batch in batches:
            length, rank = B.names_of(batch.column("length")), B.names_of(batch.column("__rank"))
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            names = [n for n in batch.schema.names if n != "__rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(rows[at, 2] + rank - rows[at, 1]), pa.array(rows[at, 3])],
                [*names, "sequence_id", "offset"])
    return run


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 0,
                   with_ids: bool = False) -> DataFrame:
    """Pack ``docs(doc_id, text, ...)`` into sequences of at most ``capacity`` ids.

    A document is the ids of its text (no special tokens added), then ``end_id``;
    only a longer one is cut, into pieces of ``capacity`` ids and a rest.  The
    tokenizer file (the format of the library ``tokenizers``) is read on the
    driver; it has to be one that drops white space and lower-cases.

    Returns per piece: doc_id, piece (from 0), start (ids of its document before
    it), length, ids_crc32 (of little-endian unsigned 32-bit ids), ``ids`` if
    ``with_ids``, sequence_id, offset (pieces of a sequence leave no gaps).  Null
    and empty texts are a piece with ``end_id`` alone.  Repeated rows and null
    doc_ids are packed like others.  Other columns are left out.  An empty table
    gives an empty table."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_file, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    schema = PIECES + (", ids array<int>" if with_ids else "")
    pieces = materialize(docs.select("doc_id", "text").mapInArrow(
        _pieces(definition, capacity, end_id, with_ids), schema), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = spark.sparkContext.broadcast(places(plan(counts, capacity)))
    order = [F.col(c) for c in ("doc_id", "piece", "start", "ids_crc32")]
    ranked = gapless(pieces, ["length"], order, F.xxhash64("doc_id", "piece", "ids_crc32"),
                     max(16, sum(counts.values()) // 20_000), "__rank")
    with batch_rows(spark, 10_000):
        return materialize(ranked.select(*pieces.columns, "__rank").mapInArrow(
            _place(table), schema + ", sequence_id long, offset long"), "packed")
