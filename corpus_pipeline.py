"""The corpus pipeline: from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept.  The first four return the columns of ``documents``, with ``n_chars`` (code
points of the text, 0 for null) brought up to date; the last returns the pieces of
the packed sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwise.llm import decontamination, line_dedup, packing, simhash, toxicity
from cartwise.llm.common import materialize
from cartwise.llm.queries import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    n_chars = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return df.withColumn("n_chars", n_chars).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"))
    return _documents(scored.where("predicted = 0"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; all documents stay."""
    return _documents(line_dedup.dedup_lines(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the smallest doc_id stays."""
    return _documents(simhash.keep_one(docs, size=3, radius=3))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that hold benchmark windows are cut out; all documents stay."""
    return _documents(decontamination.remove_contamination(docs, table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("simhash_near_dedup", drop_near_duplicates),
          ("benchmark_decontamination", remove_benchmark), ("best_fit_packing", pack)]

#: Language models, bit majorities and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
