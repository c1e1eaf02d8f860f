"""A Merkle manifest of a dataset, stored in van Emde Boas blocks.

Every row is a leaf.  The leaves of a tree (one for each value of a column) ascend
by id; ``FANOUT`` consecutive nodes are hashed to one until a single one remains,
the tree's subroot.  The subroots, in order, are the leaves of one more tree, whose
root stands for the dataset.

A tree is cut into aligned blocks of ``STEPS`` hashing steps: a block holds up to
FANOUT ** STEPS consecutive nodes and all nodes above them up to its own root, and
these block roots are the leaves of the next tier of blocks, which is made in the
same way.  Within a block the digests lie in van Emde Boas order: the subtree is
split at half its height, the upper part comes first, then the lower parts one after
another, each laid out likewise.  ``address`` computes a node's place from its depth
and number; construction and the retrieval of siblings use nothing else, so they
know no page or cache size.

Ranks within a tree come from a range-partitioned sort with counts by partition, so
neither a tree nor an id with a third of all rows is gathered; a block is the most
that a task holds.  All tables are written to the shared folder."""

from __future__ import annotations

import hashlib
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwise.llm.common import batch_bytes, materialize

FANOUT = 8
#: Hashing steps within a block: 4096 nodes become one.
STEPS = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAF = "tree long, ordinal long, size long, digest string, name long, other string"
BLOCK = "tree long, block long, size long, n int, digest string, nodes binary, names array<long>, others array<string>"
PATH = "left array<string>, right array<string>"


def subtree(levels: int) -> int:
    """Nodes of a complete subtree."""
    return (FANOUT ** levels - 1) // (FANOUT - 1)


def address(levels: int, depth: int, number: np.ndarray) -> np.ndarray:
    """Places of the nodes ``number`` at ``depth`` in a van Emde Boas layout of ``levels`` levels."""
    if levels == 1:
        return np.zeros_like(number)
    top = levels // 2
    if depth < top:
        return address(top, depth, number)
    below = FANOUT ** (depth - top)
    return (subtree(top) + number // below * subtree(levels - top)
            + address(levels - top, depth - top, number % below))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def steps_of(size: int) -> int:
    """Hashing steps of a block in a tier of ``size`` nodes: the last block of a
    tree ends where a single node remains."""
    steps = 0
    while steps < STEPS and FANOUT ** steps < size:
        steps += 1
    return steps


class Block:
    """The digests of a block, found by address."""

    def __init__(self, n: int, steps: int, nodes: np.ndarray | None = None):
        self.levels = steps + 1
        self.counts = [-(-n // FANOUT ** (steps - d)) for d in range(self.levels)]
        if nodes is None:
            most = max(int(self.at(d)[-1]) for d in range(self.levels))
            nodes = np.zeros((most + 1, 32), np.uint8)
        self.nodes = nodes

    def at(self, depth: int) -> np.ndarray:
        return address(self.levels, depth, np.arange(self.counts[depth], dtype=np.int64))

    def put(self, depth: int, digests: list[str]) -> None:
        self.nodes[self.at(depth)] = np.frombuffer(bytes.fromhex("".join(digests)), np.uint8).reshape(-1, 32)

    def runs(self, depth: int) -> list[str]:
        """The digests of each run of siblings, joined."""
        text = self.nodes[self.at(depth)].tobytes().hex()
        return [text[i:i + 64 * FANOUT] for i in range(0, len(text), 64 * FANOUT)]

    def build(self, leaves: list[str]) -> str:
        """Hash upwards from the leaves; the digest of the block's root."""
        self.put(self.levels - 1, leaves)
        for depth in range(self.levels - 2, -1, -1):
            self.put(depth, [_sha(run) for run in self.runs(depth + 1)])
        return self.nodes[0].tobytes().hex()

    def paths(self) -> list[tuple[list[str], list[str]]]:
        """For each leaf, from its level upwards, the siblings before it and after it."""
        levels = [self.runs(d) for d in range(self.levels - 1, 0, -1)]
        out = []
        for i in range(self.counts[-1]):
            left, right = [], []
            for runs in levels:
                at = 64 * (i % FANOUT)
                i //= FANOUT
                left.append(runs[i][:at])
                right.append(runs[i][at + 64:])
            out.append((left, right))
        return out


def _block(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("ordinal")
    size = rows.column("size")[0].as_py()
    held = Block(rows.num_rows, steps_of(size))
    root = held.build(rows.column("digest").to_pylist())
    row = {"tree": key[0].as_py(), "block": key[1].as_py(), "size": size, "n": rows.num_rows, "digest": root,
           "nodes": held.nodes.tobytes(), "names": rows.column("name").to_pylist(), "others": rows.column("other").to_pylist()}
    return pa.Table.from_pylist([row], schema=pa.schema([
        ("tree", pa.int64()), ("block", pa.int64()), ("size", pa.int64()), ("n", pa.int32()), ("digest", pa.string()),
        ("nodes", pa.binary()), ("names", pa.list_(pa.int64())), ("others", pa.list_(pa.string()))]))


def build(leaves: DataFrame) -> list[DataFrame]:
    """The tiers of blocks of all trees; ``leaves`` is as ``LEAF``, with gapless
    ordinals and the number of leaves of the tree as ``size``."""
    most = leaves.agg(F.max("size")).first()[0] or 0
    per, tiers = FANOUT ** STEPS, []
    while True:
        blocked = leaves.withColumn("block", F.expr(f"ordinal div {per}"))
        tiers.append(materialize(blocked.groupBy("tree", "block").applyInArrow(_block, BLOCK), "manifest-blocks"))
        if most <= per:
            return tiers
        most = -(-most // per)
        leaves = tiers[-1].where(f"size > {per}").select(
            "tree", F.col("block").alias("ordinal"), F.expr(f"(size + {per - 1}) div {per}").alias("size"),
            "digest", F.lit(None).cast("long").alias("name"), F.lit(None).cast("string").alias("other"))


def _opened(batches):
    """Blocks with the path above them, as rows (path, hex digests by leaf)."""
    for batch in batches:
        for row in batch.to_pylist():
            held = Block(row["n"], steps_of(row["size"]), np.frombuffer(row["nodes"], np.uint8).reshape(-1, 32))
            yield row, held


def _downward(batches):
    """(tree, block below or name, left, right) for every leaf of the blocks."""
    for row, held in _opened(batches):
        first = row["block"] * FANOUT ** STEPS
        paths = held.paths()
        yield pa.RecordBatch.from_arrays(
            [pa.array([row["tree"]] * len(paths), pa.int64()), pa.array(range(first, first + len(paths)), pa.int64()),
             pa.array(row["names"], pa.int64()), pa.array([x + row["left"] for x, _ in paths], pa.list_(pa.string())),
             pa.array([x + row["right"] for _, x in paths], pa.list_(pa.string()))],
            ["tree", "block", "name", "left", "right"])


def _proofs(batches):
    """The proof of every leaf, and the root that folding up from ``other`` (else
    from the leaf itself) gives."""
    for row, held in _opened(batches):
        leaves = "".join(held.runs(held.levels - 1))
        proofs, folded, own = [], [], []
        for i, (left, right) in enumerate(held.paths()):
            left, right = left + row["left"], right + row["right"]
            own.append(leaves[64 * i:64 * i + 64])
            proofs.append(_sha("".join(a + b for a, b in zip(left, right))))
            now = row["others"][i] or own[-1]
            for a, b in zip(left, right):
                now = _sha(a + now + b)
            folded.append(now)
        n = len(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array(row["names"], pa.int64()), *(pa.array(x, pa.string()) for x in (
                own, [row["subroot"]] * n, [row["root"]] * n, proofs, folded))],
            ["name", "leaf", "subroot", "root", "proof_sha256", "folded_root"])


def descend(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """Blocks of the lowest tier with the path above them: ``above`` has, by tree,
    the path over the tree's root, and further columns that are handed on."""
    extra = [c for c in above.columns if c not in ("tree", "left", "right")]
    per = FANOUT ** STEPS
    path = None
    for t in range(len(tiers) - 1, -1, -1):
        blocks = tiers[t]
        ends = blocks.where(f"size <= {per}").join(above, "tree")  # the tree's last tier
        if path is not None:
            ends = ends.unionByName(blocks.where(f"size > {per}").join(above.select("tree", *extra), "tree")
                                    .join(path.select("tree", "block", "left", "right"), ["tree", "block"]))
        if t:
            path = materialize(ends.select("tree", "block", "size", "n", "nodes", "names", "left", "right").mapInArrow(
                _downward, f"tree long, block long, name long, {PATH}"), "manifest-paths")
    return ends


def number(rows: DataFrame, by: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rank rows within the values of ``by`` (nulls first) by ``order``.

    Returns the rows with ``tree`` (a number that ascends with ``by``), ``ordinal``
    and ``size``, and the trees (tree, ordinal among the trees, size)."""
    keys = [F.col(c).asc_nulls_first() for c in (by, *order)]
    sorted_rows = rows.withColumn("__at", F.monotonically_increasing_id()).repartitionByRange(
        *keys, F.col("__at")).sortWithinPartitions(*keys).drop("__at")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def ranks(batches):
        part, run, local, last = TaskContext.get().partitionId(), -1, 0, ()
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values = batch.column(by).to_pylist()
            runs, locals_ = np.empty(n, np.int64), np.empty(n, np.int64)
            for i, value in enumerate(values):
                if (value,) != last:
                    run, local, last = run + 1, 0, (value,)
                runs[i], locals_[i] = run, local
                local += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(runs), pa.array(locals_)],
                                             [*batch.schema.names, "__part", "__run", "__local"])

    ranked = materialize(sorted_rows.mapInArrow(ranks, f"{kinds}, __part long, __run long, __local long"), "manifest-ranks")
    runs = ranked.groupBy("__part", "__run", F.col(by).alias("__by")).agg(F.count(F.lit(1)).alias("n"))
    runs = materialize(runs, "manifest-runs")  # a row for each value and partition
    of = Window.partitionBy("__by")
    before = of.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("__part", "__run", F.min((F.col("__part") * (1 << 32)) + F.col("__run")).over(of).alias("tree"),
                         F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"), F.sum("n").over(of).alias("size"))
    starts = materialize(starts, "manifest-starts")
    numbered = ranked.join(starts, ["__part", "__run"]).withColumn("ordinal", F.col("__start") + F.col("__local"))
    # the trees that begin in a partition, and before it
    trees = starts.where("tree = __part * 4294967296 + __run").select("__part", "tree", "size")
    counts = trees.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    base = counts.select("__part", F.coalesce(F.sum("n").over(
        Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy("tree")) - 1
    trees = trees.withColumn("__own", own).join(base, "__part").select(
        "tree", (F.col("__own") + F.col("__base")).cast("long").alias("ordinal"), "size")
    return numbered.drop("__part", "__run", "__local", "__start"), trees


def row_digest(columns: list[Column]) -> Column:
    """SHA-256 of the values: ``-`` for null, else UTF-8 byte count, ``:`` and the value."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def manifest(rows: DataFrame, name: str, by: str) -> DataFrame:
    """Proofs of all rows (name, by, digest, other): ``digest`` is the leaf, and
    ``other`` a digest to fold up in its place (null: the leaf itself).

    Returns name, leaf, subroot, root, proof_sha256 (of the siblings from the leaf to
    the root, left to right), folded_root.  Rows with equal (by, name) follow each
    other by digest; nulls come first.  An empty table gives an empty one."""
    slim = materialize(rows.select(F.col(name).alias("name"), F.col(by).alias("by"), "digest", "other"), "manifest-leaves")
    with batch_bytes(rows.sparkSession, 4 << 20):
        numbered, trees = number(slim, "by", ["name", "digest"])
        tiers = build(numbered.select("tree", "ordinal", "size", "digest", "name", "other"))
        tops = [t.where(f"size <= {FANOUT ** STEPS}").select("tree", "digest") for t in tiers]
        subroots = tops[0]
        for t in tops[1:]:
            subroots = subroots.union(t)
        subroots = materialize(subroots, "manifest-subroots")
        total = subroots.count()
        crown = build(trees.drop("size").join(subroots, "tree").select(
            F.lit(0).cast("long").alias("tree"), "ordinal", F.lit(total).cast("long").alias("size"), "digest",
            F.col("tree").alias("name"), F.lit(None).cast("string").alias("other")))
        root = crown[-1].select("digest").first()
        no_path = F.array().cast("array<string>")
        start = rows.sparkSession.range(1).select(F.col("id").alias("tree"), no_path.alias("left"), no_path.alias("right"))
        over = descend(crown, start).select("tree", "block", "size", "n", "nodes", "names", "left", "right").mapInArrow(
            _downward, f"tree long, block long, name long, {PATH}")
        over = materialize(over.select(F.col("name").alias("tree"), "left", "right").join(
            subroots.withColumnRenamed("digest", "subroot"), "tree").withColumn("root", F.lit(root["digest"] if root else None).cast("string")),
            "manifest-paths")
        held = descend(tiers, over).select("size", "n", "nodes", "names", "others", "left", "right", "subroot", "root")
        return materialize(held.mapInArrow(
            _proofs, "name long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"), "manifest-proofs")


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def verify_documents(docs: DataFrame, every: int = 3) -> DataFrame:
    """The manifest of ``documents`` and a check of it against tampered rows.

    A leaf is the digest of doc_id, source, lang, n_chars and text; a tree holds a
    lang.  Rows whose crc32(decimal doc_id) is a multiple of ``every`` are tampered
    with: A-Z of their text become lower-case.  Their folded root is recomputed from
    the tampered row and the manifest's siblings.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified (the
    folded root is the root).  Further columns of ``docs`` are left out.  Rows with a
    null doc_id come first in their tree and are not tampered with; repeated rows are
    leaves of their own; rows that share a doc_id follow each other by leaf."""
    text = F.translate(F.col("text"), _UPPER, _LOWER)
    first = [F.col(c) for c in COLUMNS[:-1]]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    rows = docs.select("doc_id", "lang", row_digest([*first, F.col("text")]).alias("digest"),
                       F.when(hit, row_digest([*first, text])).alias("other"))
    out = manifest(rows, "doc_id", "lang")
    return out.withColumnRenamed("name", "doc_id").withColumn("verified", F.col("folded_root") == F.col("root"))


def brute_force(rows: list[tuple], every: int = 3) -> list[tuple]:
    """The same rows by plain loops: (doc_id, leaf, subroot, root, proof, folded, verified), for tests.
    ``rows`` are (doc_id, source, lang, n_chars, text)."""
    import zlib

    def leaf(row):
        return _sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def climb(level):
        levels = [level]
        while len(levels[-1]) > 1:
            now = levels[-1]
            levels.append([_sha("".join(now[i:i + FANOUT])) for i in range(0, len(now), FANOUT)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            at = i - i % FANOUT
            out.append((level[at:i], level[i + 1:at + FANOUT]))
            i //= FANOUT
        return out

    langs: dict[Any, list[tuple]] = {}
    for row in rows:
        langs.setdefault(row[2], []).append(row)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        held = sorted(langs[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = (held, climb([leaf(r) for r in held]))
    crown = climb([trees[lang][1][-1][0] for lang in order])
    out = []
    for k, lang in enumerate(order):
        held, levels = trees[lang]
        for i, row in enumerate(held):
            steps = path(levels, i) + path(crown, k)
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % every == 0
            fold = row[:4] + (row[4] and row[4].translate(str.maketrans(_UPPER, _LOWER)),)
            now = leaf(fold) if hit else levels[0][i]
            for a, b in steps:
                now = _sha("".join(a) + now + "".join(b))
            proof = _sha("".join(x for a, b in steps for x in (*a, *b)))
            out.append((row[0], levels[0][i], levels[-1][0], crown[-1][0], proof, now, now == crown[-1][0]))
    return out
