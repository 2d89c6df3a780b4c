"""The corpus pipeline: language ID, exact dedup, near-duplicate groups, personal data, packing.

Each stage takes what its predecessor kept, written as Parquet and read again, and returns the documents that it keeps
with the columns of ``documents``; the last returns their packed pieces. Stages decide by rows, looked at each on its own
or numbered first, as ids may be null or repeat.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, jaccard_join, langid, packing, pii
from tidemark.llm.common import keyed, materialize, read

#: A language must have this share of the probability of all; with less, as with no letters at all, a document goes.
CONFIDENCE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language. Rejected: no text, no letter, or no language more likely than the others together."""
    return langid.keep(docs, langid.learned(docs), CONFIDENCE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal without white space, one."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (80 % of five-word shingles), one row: with the smallest id, null before all."""
    rows = keyed(docs)
    linked = jaccard_join.link(rows, doc_id="_row").select(F.col("doc_id").alias("_row"), "component_id")
    linked = materialize(linked.join(rows.select("_row", "doc_id"), "_row"), "linked")
    first = linked.groupBy("component_id").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "_row")).alias("first"))
    first = materialize(first.where("n > 1").select("component_id", F.col("first._row").alias("kept")), "first")
    gone = linked.join(first, "component_id").where("_row <> kept").select("_row")
    return rows.join(gone, "_row", "left_anti").select(*docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the names of its kinds and n_chars to match."""
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_duplicates", near), ("pii", private), ("packing", pack)]

#: Trained models and tokenizers are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
