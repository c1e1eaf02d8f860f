"""WARC records and the Merkle audit."""

from pyspark.sql import functions as F

from cartwise.llm import warc

PLACE = ["file", "ordinal", "offset", "length", "record"]


def pages(spark, n=300):
    rows = [(i, f"http://a/{i % 50}", "é<html>\r\n\r\n" + "x" * (i % 37)) for i in range(n)]
    rows += [(7, "http://a/7", "again"), (None, None, None), (n + 1, "http://b", None), (n + 2, "http://b", "")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit("x"))


def test_round_trip(spark):
    df = pages(spark)
    archive = warc.write_archive(df, per_file=64)
    back = sorted((r["url"], r["html"]) for r in warc.read_archive(archive).collect())
    assert back == sorted((r["url"] or "", r["html"] or "") for r in df.collect())
    ends = {}
    for r in archive.orderBy("file", "ordinal").collect():
        assert r["offset"] == ends.get(r["file"], 0) and r["length"] == len(r["record"])
        ends[r["file"]] = r["offset"] + r["length"]


def test_audit_matches_brute_force(spark):
    one = warc.write_archive(pages(spark), per_file=100).cache()
    other = (warc.damaged(one, every=11).where("not (file = 1 and ordinal >= 90)")
             .unionByName(one.where("file = 2 and ordinal = 3").withColumn("ordinal", F.lit(500).cast("long")))
             .withColumn("record", F.expr("case when file = 0 and ordinal = 5 then null else record end")))
    got = {(r["file"], r["node"]): r["state"] for r in warc.audit(one, other, fanout=4).collect()}
    assert got == warc.brute_force(*([tuple(r) for r in x.select(*PLACE).collect()] for x in (one, other)))
    assert set(got.values()) == {"corrupt", "missing", "added"}


def test_only_differing_branches_are_compared(spark):
    one = warc.write_archive(pages(spark, 1000).where("page_id is not null"), per_file=2000).cache()
    other = one.withColumn("record", F.expr("case when ordinal = 700 then encode('gone', 'utf-8') else record end"))
    found = warc.audit(one, other, fanout=8).collect()
    assert [(r["node"], r["state"]) for r in found] == [(700, "corrupt")]
    assert found[0]["n_compared"] <= 1 + 8 * 4


def test_equal_and_empty(spark):
    one = warc.write_archive(pages(spark, 20))
    assert warc.audit(one, one).count() == 0
    assert warc.audit(one.limit(0), one.limit(0)).count() == 0
