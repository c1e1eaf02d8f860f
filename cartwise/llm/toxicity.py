"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary documents, give each word a probability from
its continuation count (in how many contexts, here different preceding words, it follows), less an absolute discount.  What a word loses to the
discount comes back from a backoff that both models share: its continuation count
over all documents, labelled or not.  A rare word thus has the same probability
in both, and only words whose counts stand out compare unequally.  A text is scored by
its log-likelihoods, toxic less ordinary, per word and per square root of words;
words whose two probabilities differ by less than a margin count as even.  Discount
and margin are the one of ``SETTINGS`` that fits labelled texts best which the
counts have not seen.

A context counts once however many documents hold it.  The vocabulary is what the
labelled texts of the counts hold; every other word is the one unknown word, which is
even.  Contexts are any words of any document.  Tasks send their different pairs of a
word and its context, with the classes that hold them, packed and dealt by word; words
that are frequent in the corpus are dealt further by context.  A bucket makes its
pairs different and counts them by word; Spark adds a word's counts up.  Contexts are
counted, but the models are of order one: with word pairs as a second order, held-out
ranking got much worse (see the README).

Words are compared by 64-bit hashes, the contexts of a word by 62 bits less those that
number the vocabulary (40 bits for two million words, so of a million contexts of a
word about half a one is lost).  The vocabulary, at most the words of ``max_labelled``
texts, goes to the driver and the tasks, 12 bytes a word.

Labels are learned from at most ``max_labelled`` rows, those with the least hashes
of their doc_id; all other counts are over all documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwise.llm import bytetext as B
from cartwise.llm.common import materialize, small_batches, text_bytes

#: Pairs of a word and its context that a task holds before it makes them different
#: and, if more than half are left, sends them.
HELD = 1 << 21
#: A word that occurs this often within ``HELD`` words is reported as frequent.
OFTEN = 256
#: Occurrences of a frequent word for each part that its contexts are dealt over.
PART = 1 << 19
#: Bytes of text for each bucket of pairs.
BUCKET_BYTES = 1 << 24
#: (discount of a continuation count, least difference of logarithms that counts)
SETTINGS = ((0.75, 3.0), (1.5, 3.0), (3.0, 3.0), (3.0, 2.0), (6.0, 2.0), (0.75, 0.0), (1.5, 0.0), (3.0, 0.0), (6.0, 0.0))


def contexts(texts: B.Texts) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and a hash of the word before (0 at a text's start)."""
    texts.words(B.ALNUM, lower=True)
    h = texts.hashes()
    before = np.append(np.uint64(0), h[:-1])[:len(h)]
    before[texts.first[:-1][np.diff(texts.first) > 0]] = 0
    return h, B.mix(before * np.uint64(3))


def different(keys: np.ndarray) -> np.ndarray:
    """Sorted different keys; their last two bits are those of all that are else alike."""
    keys = np.sort(keys)
    pairs = keys >> np.uint64(2)
    first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])[:len(keys)])
    return np.bitwise_or.reduceat(keys, first) if len(first) else keys


def planes(x: np.ndarray, width: int) -> bytes:
    """The ``width`` low bytes of whole numbers, all lowest bytes first: high bytes of
    small numbers are zeros in a row, which the shuffle's compression removes."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def whole(data: bytes, width: int) -> np.ndarray:
    """What ``planes`` was given."""
    own = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((own.shape[1], 8), np.uint8)
    out[:, :width] = own.T
    return out.view("<u8").ravel()


class Deal:
    """Buckets of pairs.  A pair is a key: the place of its word in the vocabulary (the
    unknown word comes last), ``bits`` of its context, and two class bits.

    Words are dealt over ``buckets`` in their order; a word of ``parts`` p goes to 2**p
    buckets from there on by its context.  The unknown word goes to all."""

    def __init__(self, names: np.ndarray, occurrences: np.ndarray, buckets: int):
        self.names, self.buckets = names, buckets
        self.parts = np.ceil(np.log2(np.append(occurrences, PART * buckets) / PART + 1)).astype(np.uint8)
        self.bits = 62 - len(names).bit_length()
        self.width = (self.bits + 2 + 7) // 8

    def keys(self, word: np.ndarray, context: np.ndarray, classes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.names, word)
        at[np.append(self.names, np.uint64(0))[at] != word] = len(self.names)
        return ((at.astype(np.uint64) << np.uint64(self.bits + 2)) | (context >> np.uint64(64 - self.bits) << np.uint64(2))
                | classes.astype(np.uint64))

    def split(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word and rest of each key."""
        own = np.uint64(self.bits + 2)
        return keys >> own, keys & ((np.uint64(1) << own) - np.uint64(1))

    def pack(self, keys: np.ndarray) -> pa.RecordBatch:
        """Rows (bucket, words, contexts) of sorted keys."""
        word, rest = self.split(keys)
        own = np.uint64(self.buckets)
        part = (rest >> np.uint64(2)) & ((np.uint64(1) << self.parts[word].astype(np.uint64)) - np.uint64(1))
        bucket = (word * own // np.uint64(len(self.names) + 1) + part) % own
        order = np.argsort(bucket, kind="stable")
        ends = np.cumsum(np.bincount(bucket.astype(np.int64), minlength=self.buckets))
        rows = []
        for i in np.flatnonzero(np.diff(ends, prepend=0)):
            at = order[ends[i - 1] if i else 0:ends[i]]
            rows.append((i, planes(np.diff(word[at], prepend=np.uint64(0)), 4), planes(rest[at], self.width)))
        bucket, words, contexts = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(words, pa.binary()), pa.array(contexts, pa.binary())],
                                          ["bucket", "words", "contexts"])

    def unpack(self, words: bytes, contexts: bytes) -> np.ndarray:
        return (np.cumsum(whole(words, 4), dtype=np.uint64) << np.uint64(self.bits + 2)) | whole(contexts, self.width)


def _vocabulary(labels):
    """Rows (word, known, n): words of labelled texts, and how often frequent words occur."""
    def run(batches):
        ids = labels.value[0]
        held, known, n = [], [], 0

        def rows():
            word, count = np.unique(np.concatenate(held), return_counts=True)
            often = count >= OFTEN
            own = np.unique(np.concatenate(known))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.append(own, word[often]).view(np.int64)), pa.array(np.arange(len(own) + often.sum()) < len(own)),
                 pa.array(np.append(np.zeros(len(own), np.int64), count[often]))], ["word", "known", "n"])
        for batch in batches:
            for part, texts in B.text_chunks(batch):
                word, _ = contexts(texts)
                held.append(word)
                known.append(np.unique(word[(find(ids, part.column("doc_id")) >= 0)[texts.doc]]))
                n += len(word)
                if n > HELD:
                    yield rows()
                    held, known, n = [], [], 0
        if held:
            yield rows()
    return run


def find(ids: np.ndarray, doc_id: pa.Array) -> np.ndarray:
    """The place of each id in sorted ``ids``, or -1."""
    if not len(ids):
        return np.full(len(doc_id), -1)
    doc = doc_id.fill_null(0).to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(ids, doc), len(ids) - 1)
    return np.where((ids[at] == doc) & doc_id.is_valid().to_numpy(zero_copy_only=False), at, -1)


#: The class bits of a pair by the kind of a text: ordinary, toxic, neither.
CLASSES = np.array([1, 2, 0], np.int8)


def _pairs(labels, deal):
    def run(batches):
        ids, toxic = labels.value
        own = deal.value
        held, n = [], 0
        for batch in batches:
            for part, texts in B.text_chunks(batch):
                at = find(ids, part.column("doc_id"))
                kind = CLASSES[np.where(at >= 0, np.append(toxic, -1)[at], -1)]
                word, context = contexts(texts)
                held.append(own.keys(word, context, kind[texts.doc]))
                n += len(word)
                if n > HELD:
                    held = [different(np.concatenate(held))]
                    n = len(held[0])
                    if n > HELD // 2:
                        yield own.pack(held[0])
                        held, n = [], 0
        if held:
            yield own.pack(different(np.concatenate(held)))
    return run


def _counts(deal):
    """Rows (at, n, n0, n1): the different contexts of each word of a bucket, of all,
    ordinary and toxic texts."""
    def run(table: pa.Table) -> pa.Table:
        own = deal.value
        keys = different(np.concatenate([own.unpack(w.as_py(), c.as_py()) for w, c in zip(table["words"], table["contexts"])]))
        word, rest = own.split(keys)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1])[:len(word)])
        return pa.table({"at": word[first].astype(np.int32), "n": np.diff(np.append(first, len(word))),
                         **{f"n{k}": np.add.reduceat(((rest >> np.uint64(k)) & np.uint64(1)).astype(np.int64), first) for k in (0, 1)}})
    return run


def compare_words(counts: np.ndarray, words: np.ndarray, discount: float, margin: float) -> np.ndarray:
    """The log-likelihood of a word, toxic less ordinary, for each different row of
    ``counts`` (of all, ordinary, toxic); ``words`` says how many words have the row."""
    total = ((counts[:, 0] + 0.5) * words).sum()
    logs = []
    for own in counts[:, 1:].T.astype(np.float64):
        back = np.minimum((own * words).sum() * (counts[:, 0] + 0.5) / total, discount)
        p = np.maximum(own - discount, 0) + back
        logs.append(np.log(p / (p * words).sum()) if own.any() else np.zeros(len(own)))
    found = logs[1] - logs[0]
    return np.where(np.abs(found) > margin, found, 0).astype(np.float32)


def compare(texts: B.Texts, words: np.ndarray, kind: np.ndarray, tables: list[np.ndarray]) -> list[np.ndarray]:
    """Rows (per word, per root of words) of log-likelihoods, toxic less ordinary, for
    each table of the kinds of the sorted ``words``; other words are even."""
    h = texts.words(B.ALNUM, lower=True).hashes()
    n = np.maximum(np.diff(texts.first), 1)
    at = np.searchsorted(words, h)
    known = np.append(words, np.uint64(0))[at] == h
    own_kind = np.append(kind, 0)[at]
    out = []
    for table in tables:
        total = np.append(0, np.cumsum(np.where(known, table[own_kind], np.float32(0)), dtype=np.float64))
        own = total[texts.first[1:]] - total[texts.first[:-1]]
        out.append(np.column_stack([own / n, own / np.sqrt(n)]))
    return out


def probability(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and offset of a lightly shrunk logistic regression (Newton steps)."""
    scale = np.append(x.std(axis=0) + 1e-9, 1)
    z = np.column_stack([x, np.ones(len(x))]) / scale
    shrink = np.diag([1e-4] * x.shape[1] + [1e-9]) * len(x)
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z.T * (p * (1 - p) + 1e-9)) @ z + shrink, z.T @ (y - p) - shrink @ w)
    return w / scale


def _calibration(tables, ids):
    def run(batches):
        for batch in batches:
            own = batch.filter(pa.array(find(ids.value, batch.column("doc_id")) >= 0))
            for part, texts in B.text_chunks(own):
                x = np.concatenate(compare(texts, *tables.value), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "x"])
    return run


def _scores(words, weights):
    def run(batches):
        for batch in batches:
            for part, texts in B.text_chunks(batch):
                score = np.zeros(len(texts)) if weights is None else probability(compare(texts, *words.value)[0], weights)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*part.schema.names, "__score"])
    return run


def best_fit(x: np.ndarray, y: np.ndarray) -> tuple[int, np.ndarray]:
    """The setting whose two columns of ``x`` predict ``y`` with the least loss, and
    its weights."""
    fits = []
    for k in range(x.shape[1] // 2):
        own = x[:, 2 * k:2 * k + 2]
        weights = logistic(own, y)
        p = np.clip(probability(own, weights), 1e-9, 1 - 1e-9)
        fits.append((-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)), k, weights))
    _, k, weights = min(fits, key=lambda f: f[:2])
    return k, weights


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def count_contexts(docs: DataFrame, train: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of the words of ``train`` (ids, toxic) texts, and rows of counts
    (of different contexts in all, ordinary and toxic texts) of these words and, last,
    of the unknown word."""
    spark = docs.sparkSession
    labels = spark.sparkContext.broadcast(train)
    found = (docs.mapInArrow(B.frugal(_vocabulary(labels)), "word long, known boolean, n long").groupBy("word")
             .agg(F.max("known").alias("known"), F.sum("n").alias("n")).where("known").select("word", "n").toArrow())
    names = found.column("word").to_numpy().view(np.uint64)
    order = np.argsort(names)
    names = names[order]
    buckets = 1 + text_bytes(docs) // BUCKET_BYTES
    deal = spark.sparkContext.broadcast(Deal(names, found.column("n").to_numpy()[order], buckets))
    del found, order
    every = materialize(
        docs.mapInArrow(B.frugal(_pairs(labels, deal)), "bucket int, words binary, contexts binary")
        .groupBy("bucket").applyInArrow(_counts(deal), "at int, n long, n0 long, n1 long")
        .groupBy("at").agg(*(F.sum(n).alias(n) for n in ("n", "n0", "n1"))), "toxicity").toArrow()
    counts = np.zeros((len(names) + 1, 3), np.int64)
    counts[every.column("at").to_numpy()] = np.column_stack([every.column(n).to_numpy() for n in ("n", "n0", "n1")])
    return names, counts


def score_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = 1_000_000) -> DataFrame:
    """Score ``docs(doc_id, text, ...)`` after ``labels(doc_id, toxic)``.

    Labels are learned only from rows whose ``fold`` is not 0: folds 1 to 3 give
    the class counts, fold 4 the setting and the weights that turn the comparison
    into a probability.  A document with several label rows is toxic if one of them says
    so; labels other than 0 and 1, and null ones, are passed over.  ``max_labelled``
    bounds the labelled rows that are used; the corpus counts cover all documents.

    Returns all columns of ``docs`` with held_out (fold 0), score (0 to 1) and
    predicted (1 from 0.5 on) added; input columns of these names are replaced.
    Null and empty texts get the score of an even comparison.  Null doc_ids are
    scored like others; they are not labelled and not held out.  Repeated rows
    are scored alike.  Unless both labels occur in folds 1 to 3 and in fold 4,
    every score is 0.  An empty table gives an empty table."""
    spark = docs.sparkSession
    small_batches(spark)
    usable = F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != 0)
    known = (labels.where(usable).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max("toxic").cast("long").alias("toxic")).withColumn("fold", fold(F.col("doc_id")).cast("int"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).toPandas().sort_values("doc_id"))
    train, check = ((own["doc_id"].to_numpy(np.int64), own["toxic"].to_numpy(np.int64))
                    for own in (known[known["fold"] < 4], known[known["fold"] == 4]))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = weights = None
    if all(len(set(own[1])) == 2 for own in (train, check)):
        names, counts = count_contexts(keyed, train)
        # words of the same counts are of one kind; the unknown word is the last row
        counts, kind, alike = np.unique(counts, axis=0, return_inverse=True, return_counts=True)
        kind = kind.ravel()[:-1].astype(np.int32)
        tables = [compare_words(counts, alike, *setting) for setting in SETTINGS]
        shared = spark.sparkContext.broadcast((names, kind, tables))
        seen = keyed.mapInArrow(B.frugal(_calibration(shared, spark.sparkContext.broadcast(check[0]))),
                                "doc_id long, x array<double>").toPandas()
        seen["x"] = seen["x"].map(tuple)
        seen = seen.sort_values(["doc_id", "x"])
        shared.unpersist()
        y = check[1][np.searchsorted(check[0], seen["doc_id"].to_numpy())]
        if len(set(y)) == 2:
            best, weights = best_fit(np.array(seen["x"].tolist()), y)
            some = tables[best][kind] != 0
            words = spark.sparkContext.broadcast((names[some], kind[some], [tables[best]]))
    docs = docs.drop("held_out", "score", "predicted", "__score")
    scored = docs.mapInArrow(B.frugal(_scores(words, weights)), T.StructType([*docs.schema, T.StructField("__score", T.DoubleType())]))
    return scored.withColumns({"held_out": F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)), "score": F.col("__score"),
                               "predicted": (F.col("__score") >= 0.5).cast("int")}).drop("__score")
