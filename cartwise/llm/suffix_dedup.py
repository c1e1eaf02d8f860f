"""Deduplication of repeated byte strings through suffix arrays.

Every start of a ``width``-byte string is dealt by its anchor: the place within the
string whose ``gram``-byte hash is least.  Equal strings have equal anchors at the same
place, so a string that occurs twice meets its equal under that anchor.  Consecutive
starts with one anchor are a segment.  A scan makes a row of hashes for each segment;
anchors that occur once, which are most, end there.  Equal segments are one class
with a number of copies (their strings all repeat), and only one segment of each
class is fetched, and only where classes differ under one anchor.

The fetched segments of a bucket of anchors are joined to one text and sorted by a
linear grouping suffix array.  A symbol of that text is a cell of bytes, counted from
the anchor, so that suffixes share a symbol only at the same place under the same
anchor.  Common prefixes of neighbouring suffixes tell, for every start, whether all
cells within its string occur elsewhere (else the string is unique) and whether the
cells that enclose it do (then it repeats).  Strings in between are compared by
their bytes.

The suffix array groups suffixes by their longest Lyndon prefix: groups are taken in
descending order, and each gives the suffixes that its members' previous-smaller
pointers lead to a longer prefix, hence groups of their own right above their old
ones.  Then the suffixes are emitted in ascending order, each into the next place of
the group of the suffixes that it follows.  No rank is ever renamed.

An anchor with more than ``most`` classes isn't brought together: its strings become
rows by 128-bit hash, counted by Spark."""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwise.llm import bytetext as B
from cartwise.llm.common import batch_bytes, materialize

#: Bytes of fetched segments in a bucket; starts of a document handled at once.
BUCKET_BYTES, PIECE = 4 << 20, 1 << 20
#: Texts to fetch from whose ids may be broadcast (two longs each).
BROADCAST_DOCS = 1_000_000
#: Low bits that hold a place beside a hash.
PLACE = np.uint64((1 << 22) - 1)
SEGMENT = "doc_id long, key long, anchor long, print long, first int, n int, at int"
CLASS = "anchor long, print long, copies long, classes long, first int, n int, at int"


def suffix_array(text: list[int]) -> list[int]:
    """The suffixes of ``text`` in ascending order; its last symbol must be smaller
    than all others."""
    n = len(text)
    symbols = {c: g for g, c in enumerate(sorted(set(text)))}
    group = [symbols[c] for c in text]
    members: list[list[int]] = [[] for _ in symbols]
    for s, g in enumerate(group):
        members[g].append(s)
    length = [1] * len(members)
    lower, upper = list(range(-1, len(members) - 1)), [*range(1, len(members)), -1]
    done = bytearray(len(members))
    smaller = [-1] * n
    now = len(members) - 1
    while now >= 0:
        led: list[list[int]] = []  # suffixes that are led on, and how often
        often = 1
        for s in members[now]:
            if group[s] != now:
                continue
            p = s - 1
            while p >= 0:
                g = group[p]
                if g == now:
                    p = smaller[p]
                    break
                if not done[g]:
                    break
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                if led and led[-1][0] == p:
                    led[-1][1] += 1
                    often = max(often, led[-1][1])
                else:
                    led.append([p, 1])
        done[now] = 1
        for k in range(often, 0, -1) if often < 4 else sorted({k for _, k in led}, reverse=True):
            fresh: dict[int, int] = {}
            for p, times in led:
                if times != k:
                    continue
                old = group[p]
                new = fresh.get(old)
                if new is None:
                    new = fresh[old] = len(members)
                    members.append([])
                    length.append(length[old] + k * length[now])
                    done.append(0)
                    above = upper[old]
                    lower.append(old)
                    upper.append(above)
                    upper[old] = new
                    lower[above] = new
                group[p] = new
                members[new].append(p)
        now = lower[now]
    # places of the groups, from the lowest
    sizes = [0] * len(members)
    for g in group:
        sizes[g] += 1
    place, at, g = [0] * len(members), 0, 0
    while g >= 0:
        place[g] = at
        at += sizes[g]
        g = upper[g]
    follower, sibling = [-1] * (n + 1), [-1] * n
    for s in range(n):
        end = s + length[group[s]]
        sibling[s], follower[end] = follower[end], s
    order = [n - 1] * n
    place[group[n - 1]] += 1
    for i in range(n):
        s = follower[order[i]]
        while s >= 0:
            g = group[s]
            order[place[g]] = s
            place[g] += 1
            s = sibling[s]
    return order


def segments(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, first start, starts, anchor's place after the first start) of
    the segments of some texts; starts are places in ``data``."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < width:
        return none, none.astype(np.uint64), none, none, none
    up, down = B.powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(B._BYTE[data] * up[:-1], out=sums[1:])
    grams = B.mix((sums[gram:] - sums[:-gram]) * down[:n - gram + 1])
    values = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    span = width - gram + 1
    padded = np.full(-(-len(values) // span) * span, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    rows = padded.reshape(-1, span)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[:n - width + 1], before[span - 1:span - 1 + n - width + 1])
    anchor = (least & PLACE).astype(np.int64)
    long = np.flatnonzero(np.diff(offsets) >= width)
    step = np.zeros(n + 1, np.int64)
    step[offsets[long]] += 1
    step[offsets[long + 1] - width + 1] -= 1
    starts = np.flatnonzero(np.cumsum(step)[:n - width + 1])
    if not len(starts):
        return none, none.astype(np.uint64), none, none, none
    own = anchor[starts]
    cut = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)))
    first = starts[cut]
    return (np.searchsorted(offsets, first, "right") - 1, grams[own[cut]], first,
            np.diff(np.append(cut, len(starts))), own[cut] - first)


def _scan(width: int, gram: int, piece: int):
    def scan(batches):
        for batch in batches:
            for part, texts in B.text_chunks(batch):
                ids, keys = part.column("doc_id").to_pylist(), part.column("key").to_numpy()
                long = len(texts) == 1 and len(texts.data) > 2 * piece
                pieces = range(0, len(texts.data), piece) if long else (0,)
                for at in pieces:  # a long text in pieces whose starts follow each other
                    data = texts.data[at:at + piece + width - 1] if long else texts.data
                    doc, anchor, first, n, place = segments(data, np.array([0, len(data)]) if long else texts.offsets, width, gram)
                    if not len(doc):
                        continue
                    held = data.tobytes()
                    prints = [xxhash.xxh3_64_intdigest(held[a:b]) for a, b in zip(first.tolist(), (first + n + width - 1).tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[d] for d in doc], pa.int64()), pa.array(keys[doc], pa.int64()), pa.array(anchor.view(np.int64)),
                         pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(first + at - texts.offsets[doc], pa.int32()),
                         pa.array(n, pa.int32()), pa.array(place, pa.int32())],
                        ["doc_id", "key", "anchor", "print", "first", "n", "at"])
    return scan


def _fetch(width: int):
    """The bytes of the segments that are asked for, each once in a task: rows that
    are alike ask for the same."""
    names = ["anchor", "print", "copies", "classes", "first", "n", "at"]

    def fetch(batches):
        seen = set()
        for batch in batches:
            for doc_id, key, text, asked in zip(*(batch.column(c) for c in ("doc_id", "key", "text", "asked"))):
                data = text.as_buffer().to_pybytes()
                asked = [x for x in asked.as_py() if (x["anchor"], x["print"]) not in seen]
                seen.update((x["anchor"], x["print"]) for x in asked)
                for at in range(0, len(asked), 4096):
                    own = asked[at:at + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc_id.as_py()] * len(own), pa.int64()), pa.array([key.as_py()] * len(own), pa.int64()),
                         *(pa.array([x[c] for x in own], pa.int32() if c in ("first", "n", "at") else pa.int64()) for c in names),
                         pa.array([data[x["first"]:x["first"] + x["n"] + width - 1] for x in own], pa.binary())],
                        ["doc_id", "key", *names, "bytes"])
    return fetch


def _joined(rows: list[dict], cell: int) -> tuple[list[int], list[int], list[int], list[int]]:
    """The text of cells of some segments, each ended by symbol 1 and all by 0; where
    each segment begins, its first cell and its number of cells."""
    keys, begins, firsts, counts = [], [], [], []
    for row in rows:
        z0 = -(row["at"] // cell)
        z1 = (len(row["bytes"]) - row["at"]) // cell
        begins.append(len(keys))
        firsts.append(z0)
        counts.append(z1 - z0)
        data, at = row["bytes"], row["at"]
        keys += [(row["anchor"], z, data[z * cell + at:(z + 1) * cell + at]) for z in range(z0, z1)]
        keys.append(None)
    rank = {k: i + 2 for i, k in enumerate(sorted({k for k in keys if k}))}
    return [rank[k] if k else 1 for k in keys] + [0], begins, firsts, counts


def shared_cells(text: list[int]) -> np.ndarray:
    """For every place, how many symbols the suffix there has in common with another
    one, up to the end of its segment."""
    order = np.array(suffix_array(text))
    held = np.array(text)
    common = np.zeros(len(text) - 1, np.int64)
    a, b = order[:-1], order[1:]
    alive = np.arange(len(common))
    while len(alive):
        same = (held[a] == held[b]) & (held[a] > 1)
        alive, a, b = alive[same], a[same] + 1, b[same] + 1
        common[alive] += 1
    out = np.zeros(len(text), np.int64)
    out[order[:-1]] = common
    out[order[1:]] = np.maximum(out[order[1:]], common)
    return out


def resolve(rows: list[dict], width: int, cell: int) -> list[np.ndarray]:
    """For each segment, which of its starts have an equal string in another one; the
    segments of an anchor follow each other."""
    text, begins, firsts, counts = _joined(rows, cell)
    shared = shared_cells(text)
    out, open_at = [], []
    for row, begin, z0, count in zip(rows, begins, firsts, counts):
        rel = np.arange(row["n"]) - row["at"]
        inner, inner_end = -(-rel // cell), (rel + width) // cell
        outer, outer_end = rel // cell, -(-(rel + width) // cell)
        maybe = shared[begin + inner - z0] >= inner_end - inner
        whole = (outer >= z0) & (outer_end <= z0 + count)
        sure = whole & (shared[begin + np.where(whole, outer - z0, 0)] >= outer_end - outer)
        out.append(sure)
        open_at.append(maybe & ~sure)
    for _, own in groupby(range(len(rows)), lambda i: rows[i]["anchor"]):  # strings of one place at a time
        own = list(own)
        for r in sorted({int(r) for i in own for r in np.flatnonzero(open_at[i]) - rows[i]["at"]}):
            there = [(i, r + rows[i]["at"]) for i in own if 0 <= r + rows[i]["at"] < rows[i]["n"]]
            strings = [rows[i]["bytes"][a:a + width] for i, a in there]
            times = Counter(strings)
            for (i, a), string in zip(there, strings):
                if open_at[i][a]:
                    out[i][a] = times[string] > 1
    return out


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] - 1


def _resolve(width: int, cell: int):
    def run(rows: pa.Table) -> pa.Table:
        held = sorted(rows.to_pylist(), key=lambda r: (r["anchor"], r["print"]))
        found: dict[str, list] = {"doc_id": [], "key": [], "begin": [], "last": []}
        for row, hit in zip(held, resolve(held, width, cell)):
            if row["copies"] == 1:
                for a, b in zip(*_runs(hit)):
                    for c, v in zip(found, (row["doc_id"], row["key"], row["first"] + int(a), row["first"] + int(b))):
                        found[c].append(v)
        del held
        B.give_back()  # the worker waits for its next task beside the executor's JVM
        return pa.table(found, schema=pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("begin", pa.int64()), ("last", pa.int64())]))
    return run


def _strings(width: int):
    """A row for each string of the segments, by its hash."""
    def strings(batches):
        for batch in batches:
            for row in batch.to_pylist():
                made = [xxhash.xxh3_128_digest(row["bytes"][a:a + width]) for a in range(row["n"])]
                halves = np.frombuffer(b"".join(made), "<i8").reshape(-1, 2)
                n = row["n"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["doc_id"]] * n, pa.int64()), pa.array([row["key"]] * n, pa.int64()), pa.array(np.full(n, row["copies"])),
                     pa.array(np.arange(n, dtype=np.int64) + row["first"]), pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                    ["doc_id", "key", "copies", "begin", "h1", "h2"])
    return strings


def repeated_strings(docs: DataFrame, width: int, gram: int, most: int) -> DataFrame:
    """(doc_id, key, begin, last): runs of starts of repeated strings."""
    scanned = materialize(docs.mapInArrow(B.frugal(_scan(width, gram, PIECE)), SEGMENT), "suffix-segments")
    anchors = scanned.groupBy("anchor").agg(F.count(F.lit(1)).alias("holders"), (F.min("print") != F.max("print")).alias("several"))
    # written first: a join onto an aggregate over its own key would not be split where an anchor is hot
    anchors = materialize(anchors.where("holders > 1").drop("holders"), "suffix-anchors")
    shared = materialize(scanned.join(anchors, "anchor"), "suffix-shared")
    several = shared.where("several")
    classes = several.groupBy("anchor", "print").agg(F.count(F.lit(1)).alias("copies"), F.min(
        F.struct("doc_id", "key", "first", "n", "at")).alias("one")).select("anchor", "print", "copies", "one.*")
    classes = materialize(classes, "suffix-classes")
    sized = classes.join(classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("classes")), "anchor")
    asked = materialize(sized.groupBy("doc_id", "key").agg(F.collect_list(F.struct(
        "anchor", "print", "copies", "classes", "first", "n", "at")).alias("asked")), "suffix-asked")

    def same(a, b):
        return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.key") == F.col(f"{b}.key"))

    d = docs.alias("d")
    if asked.count() <= BROADCAST_DOCS:  # other texts need not be shuffled
        d = d.join(F.broadcast(asked.select("doc_id", "key")).alias("k"), same("d", "k"), "left_semi").alias("d")
    texts = d.join(asked.alias("a").hint("merge"), same("d", "a")).select("d.*", "a.asked")
    fetched = texts.select("doc_id", "key", "text", "asked").mapInArrow(
        B.frugal(_fetch(width)), f"doc_id long, key long, {CLASS}, bytes binary")
    hot = not classes.groupBy("anchor").count().where(F.col("count") > most).isEmpty()
    if hot:  # read twice
        fetched = materialize(fetched, "suffix-fetched")
    total = classes.agg(F.sum(F.col("n") + width)).first()[0] or 0
    bucket = F.pmod(F.col("anchor"), F.lit(max(1, -(-total // BUCKET_BYTES))))
    found = fetched.where(F.col("classes") <= most).withColumn("bucket", bucket).repartition("bucket").dropDuplicates(
        ["bucket", "anchor", "print"]).groupBy("bucket").applyInArrow(
        _resolve(width, max(1, width // 16)), "doc_id long, key long, begin long, last long")
    if hot:
        rows = materialize(fetched.where(F.col("classes") > most).dropDuplicates(["anchor", "print"]).mapInArrow(
            _strings(width), "doc_id long, key long, copies long, begin long, h1 long, h2 long"), "suffix-strings")
        again = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("h1", "h2")
        found = found.union(rows.where("copies = 1").join(again, ["h1", "h2"]).select(
            "doc_id", "key", "begin", F.col("begin").alias("last")))
    copied = several.join(classes.where("copies > 1").select("anchor", "print"), ["anchor", "print"], "left_semi")
    whole = shared.where("not several").select(*scanned.columns).unionByName(copied.select(*scanned.columns))
    first, last = F.col("first").cast("long"), F.col("first").cast("long") + F.col("n") - 1
    return whole.select("doc_id", "key", first.alias("begin"), last.alias("last")).union(found)


def _remove(width: int):
    def remove(batches):
        for batch in batches:
            names = [c for c in batch.schema.names if c != "__spans"]
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for text, spans in zip(batch.column("text"), batch.column("__spans")):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                n_bytes.append(len(data))
                begins = sorted((s["begin"], s["last"] + width) for s in spans.as_py() or ())
                left, at, removed, runs = [], 0, 0, 0
                for a, b in begins:
                    if a > at or not runs:
                        left.append(data[at:a])
                        runs += 1
                    removed += max(0, b - max(a, at))
                    at = max(at, b)
                left.append(data[at:])
                n_removed.append(removed)
                n_spans.append(runs)
                kept.append(b"".join(left))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(kept, pa.binary())],
                [*names, "n_bytes", "n_removed", "n_spans", "kept"])
    return remove


def dedup_strings(docs: DataFrame, width: int = 400, gram: int | None = None, most: int = 4096) -> DataFrame:
    """Remove every byte covered by a ``width``-byte string that also starts anywhere
    else, in the same text or another; strings are judged on the input.

    Returns all columns of ``docs`` (doc_id, text, ...) with n_bytes (UTF-8, before),
    n_removed, n_spans (maximal removed runs) and kept (binary: the remaining bytes,
    which may cut characters); input columns of these names are replaced.  A null text
    is empty.  Rows that share a doc_id, and equal rows, are texts of their own, so equal
    rows of ``width`` bytes lose all; a null doc_id is an id like any other.  An
    empty table gives an empty one.  ``most`` is the number of different segments under
    one anchor that a task sorts together; beyond it their strings are counted by Spark.

    Segments are taken for equal by their anchors' and their own 64-bit hashes."""
    gram = gram or max(1, width // 4)
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept", "__spans", "__key")
    with batch_bytes(docs.sparkSession, 8 << 20):
        keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
        found = repeated_strings(keyed, width, gram, most)
        spans = materialize(found.groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).agg(
            F.collect_set(F.struct("begin", "last")).alias("__spans")), "suffix-spans")
        wide = docs.join(spans, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__key")), "left")
        out = T.StructType([*docs.schema, *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")),
                            T.StructField("kept", T.BinaryType())])
        return materialize(wide.select(*docs.columns, "__spans").mapInArrow(B.frugal(_remove(width)), out), "suffix-kept")


def digest(docs: DataFrame) -> DataFrame:
    """What query op13 returns."""
    return docs.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple], width: int) -> list[tuple]:
    """The digest by plain loops, for tests."""
    texts = [(t or "").encode() for _, t in rows]
    times: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - width + 1):
            times[t[i:i + width]] = times.get(t[i:i + width], 0) + 1
    out = []
    for (d, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if times[t[i:i + width]] > 1:
                gone[i:i + width] = b"\1" * width
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out
