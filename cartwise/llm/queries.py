"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwise.llm import (decontamination, embedding_dedup, lexical_search, license_scan, line_dedup, merkle_manifest, oracle, packing, sharding, simhash,
                          substring_dedup, suffix_dedup, toxicity, warc)
from cartwise.llm.common import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.digest(line_dedup.dedup_lines(docs, min_chars=40, min_docs=5))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=8)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.digest(decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"), width=10))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), least=0.9)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=3, radius=3)


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages archived, read back from the stored archive, and audited against a
    replica with faults: a row for each record, with its state."""
    archive = materialize(warc.write_archive(table(spark, sf_dir, "pages"), per_file=1_000), "warc")
    replica = warc.damaged(archive, every=101)
    faults = warc.audit(archive, replica, fanout=16).select("file", F.col("node").alias("ordinal"), "state")
    held = archive.select("file", "ordinal", "page_id", "offset", "length", F.sha2("record", 256).alias("record_sha256"))
    return (held.join(faults, ["file", "ordinal"], "left")
            .withColumn("state", F.coalesce("state", F.lit("sound"))))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), max_labelled=1_000_000).drop("text")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.digest(substring_dedup.dedup_substrings(docs, width=13))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.verify_documents(table(spark, sf_dir, "documents"), every=3)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical_search.search(docs, table(spark, sf_dir, "benchmark"), top=50)


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.digest(suffix_dedup.dedup_strings(docs, width=400))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_sharding, op3_benchmark_decontamination,
                                  op4_embedding_near_dedup, op5_best_fit_packing,
                                  op6_simhash_near_dedup, op7_warc_fixity, op8_toxicity, op9_license_scan, op10_substring_dedup,
                                  op11_merkle_manifest, op12_lexical_search, op13_suffix_array_dedup)}

SQL: dict[str, str] = {"op1_line_dedup": oracle.OP1, "op3_benchmark_decontamination": oracle.OP3,
                       "op4_embedding_near_dedup": oracle.OP4, "op7_warc_fixity": oracle.OP7,
                       "op10_substring_dedup": oracle.OP10, "op11_merkle_manifest": oracle.OP11,
                       "op12_lexical_search": oracle.OP12}
