"""WARC archives and a Merkle audit of their fixity.

An archive is a table of records: file, offset, length, record bytes.  Records of
a file follow each other without gaps.  The audit hashes every record together
with its place, and builds, for each file, a tree over ordered runs of ``fanout``
children up to one root.  Two replicas are compared by their roots; only below
nodes that differ are children compared, level by level, down to the offset ranges
whose records are corrupt, missing or added.

A tree node is an aggregate over at most ``fanout`` rows, so no file, however
large, is gathered in a task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwise.llm.common import materialize


def warc_record(url: Column, record_id: Column, payload: Column, date: str) -> Column:
    """The bytes of one WARC/1.0 response record (null url and payload: empty)."""
    body = F.coalesce(payload, F.lit("")).cast("binary")
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:"), record_id.cast("string"),
                    F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
                    F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def write_archive(pages: DataFrame, per_file: int = 1_000, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Pages(page_id, url, html) as records (file, ordinal, page_id, offset, length, record).

    A file takes the pages of ``per_file`` consecutive page_ids, in their order
    (repeated ids by url and html).  Null ids are put into file -1.  Other columns
    are left out; an empty table gives an empty archive."""
    rows = pages.select("page_id", F.coalesce(F.floor(F.col("page_id") / per_file), F.lit(-1)).cast("long").alias("file"),
                        warc_record(F.col("url"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("html"), date).alias("record"),
                        F.xxhash64("url", "html").alias("__tie"))
    order = Window.partitionBy("file").orderBy(F.col("page_id"), F.col("__tie"), F.sha2("record", 256))
    sized = rows.withColumn("length", F.octet_length("record").cast("long"))
    return sized.select("file", (F.row_number().over(order) - 1).cast("long").alias("ordinal"), "page_id",
                        (F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("offset"),
                        "length", "record")


def read_archive(archive: DataFrame) -> DataFrame:
    """Records back as pages (file, ordinal, url, html): headers end at the first
    empty line, and the content has the stated length."""
    text = F.col("record").cast("string")
    head = F.substring_index(text, "\r\n\r\n", 1)
    start = F.octet_length(head) + 5
    length = F.regexp_extract(head, r"\r\nContent-Length: (\d+)", 1).cast("int")
    return archive.select("file", "ordinal", F.regexp_extract(head, r"\r\nWARC-Target-URI: ([^\r]*)", 1).alias("url"),
                          F.substring(F.col("record"), start, length).cast("string").alias("html"))


def leaves(archive: DataFrame) -> DataFrame:
    """(file, node, digest, first, last): a leaf for each record, with its digest
    over offset, length and bytes, and its offset range [first, last)."""
    place = F.concat(F.col("offset").cast("string"), F.lit(":"), F.col("length").cast("string"), F.lit(":"))
    record = F.sha2(F.col("record").cast("binary"), 256)
    return archive.select("file", F.col("ordinal").alias("node"), F.sha2(F.concat(place, record).cast("binary"), 256).alias("digest"),
                          F.col("offset").alias("first"), (F.col("offset") + F.col("length")).alias("last"))


def parents(level: DataFrame, fanout: int) -> DataFrame:
    """The next level of the trees: a node's digest is that of its children's, in
    order, with their numbers."""
    children = F.array_sort(F.collect_list(F.struct("node", "digest")))
    joined = F.array_join(F.transform(children, lambda c: F.concat(c["node"].cast("string"), F.lit("="), c["digest"])), ",")
    return (level.groupBy("file", F.floor(F.col("node") / fanout).cast("long").alias("node"))
            .agg(F.sha2(joined.cast("binary"), 256).alias("digest"), F.min("first").alias("first"), F.max("last").alias("last"))
            .select("file", "node", "digest", "first", "last"))


def trees(archive: DataFrame, fanout: int, height: int) -> list[DataFrame]:
    """Levels from the leaves to the roots."""
    levels = [materialize(leaves(archive), "merkle-leaves")]
    for _ in range(height):
        levels.append(materialize(parents(levels[-1], fanout), "merkle-level"))
    return levels


def audit(one: DataFrame, other: DataFrame, fanout: int = 16) -> DataFrame:
    """Where two replicas (file, ordinal, offset, length, record) differ.

    Returns a row for each record that differs, in order of nothing: file, node
    (its ordinal), state ('corrupt', 'missing' or 'added': not in ``other``, not in
    ``one``), first and last (offset range in ``one``, else in ``other``),
    digest_one, digest_other, and n_compared, the tree nodes that were compared in
    its file.  Equal and empty archives give no rows; a null record counts as a
    record without bytes.  (file, ordinal) must be unique within a replica."""
    fill = {"record": F.coalesce(F.col("record"), F.lit(b""))}
    one, other = one.withColumns(fill), other.withColumns(fill)
    most = max((x.agg(F.max("ordinal")).first()[0] or 0) for x in (one, other))
    height = 0
    while fanout ** height <= most:
        height += 1
    a, b = trees(one, fanout, height), trees(other, fanout, height)
    suspects, compared = None, []
    for level in range(height, -1, -1):
        sides = [x[level].select("file", "node", *(F.col(c).alias(f"{c}_{s}") for c in ("digest", "first", "last")))
                 for x, s in ((a, "one"), (b, "other"))]
        if suspects is not None:  # children of nodes that differ, no others
            sides = [x.withColumn("__up", F.floor(F.col("node") / fanout).cast("long"))
                     .join(suspects, ["file", "__up"], "left_semi").drop("__up") for x in sides]
        both = materialize(sides[0].join(sides[1], ["file", "node"], "full"), "merkle-compared")
        compared.append(both.groupBy("file").agg(F.count(F.lit(1)).alias("n")))
        differing = both.where(~F.col("digest_one").eqNullSafe(F.col("digest_other")))
        suspects = differing.select("file", F.col("node").alias("__up"))
    total = reduce(DataFrame.unionAll, compared).groupBy("file").agg(F.sum("n").alias("n_compared"))
    state = (F.when(F.col("digest_one").isNull(), "added").when(F.col("digest_other").isNull(), "missing").otherwise("corrupt"))
    return differing.join(total, "file").select(
        "file", "node", state.alias("state"), F.coalesce("first_one", "first_other").alias("first"),
        F.coalesce("last_one", "last_other").alias("last"), "digest_one", "digest_other", "n_compared")


def damaged(archive: DataFrame, every: int) -> DataFrame:
    """A replica with faults at the records of page_ids with remainders 0, 1 and 2
    to ``every``: a byte turned, the end cut off, and the record lost."""
    h = F.pmod(F.col("page_id"), F.lit(every))
    n = F.octet_length("record")
    turned = F.concat(F.substring(F.col("record"), 1, F.lit(20)), F.lit(b"#"), F.substring(F.col("record"), F.lit(22), n))
    cut = F.substring(F.col("record"), F.lit(1), n - 1)
    return (archive.where(F.coalesce(h, F.lit(9)) != 2)
            .withColumn("record", F.when(h == 0, turned).when(h == 1, cut).otherwise(F.col("record"))))


def brute_force(one: list[tuple], other: list[tuple]) -> dict[tuple, str]:
    """(file, ordinal) -> state by plain comparison of (file, ordinal, offset, length, record)."""
    a, b = ({(f, o): (off, n, bytes(r or b"")) for f, o, off, n, r in x} for x in (one, other))
    return {k: "added" if k not in a else "missing" if k not in b else "corrupt"
            for k in {*a, *b} if a.get(k) != b.get(k)}
