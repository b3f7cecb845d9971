"""A training-corpus pipeline: five stages, each by one operator of tidemark.llm over all that the one before kept.

The columns of documents pass through unchanged up to the last stage, except where a stage rewrites the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language, near, packing, pii, store

SURROGATE_KEY = "corpus"  # a deployment passes its own secret


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised beyond doubt; dictionaries come from their own labels."""
    samples = language.dictionaries(docs)
    found = language.identify(docs.withColumn("__row", F.struct(*docs.columns)), samples, keep=["__row"])
    return found.where("accepted").select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of every class of near-duplicates the row of the smallest doc_id; null or repeated ids are no likeness.

    Repeated rows are copies: one stays. Null and empty texts have no likeness and stay; an empty table gives an empty one.
    """
    own = "__id"
    while own in docs.columns:
        own += "_"
    rows = store.kept(docs.withColumn(own, F.monotonically_increasing_id()), "numbered")  # written, so that numbers stay
    named = near.classes(rows, key=own).select(own, "class_id").join(rows.select(own, "doc_id"), own)
    first = named.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col(own).alias("own"))).alias("first"))
    return rows.join(first.select(F.col("first.own").alias(own)), own, "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    held = docs.select("doc_id", F.struct(*docs.columns).alias("__row"), "text")
    found = decontaminate.contamination(held, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["__row"])
    return found.where("not contaminated").select("__row.*")


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates; n_chars follows the new text."""
    out = pii.anonymised(docs, SURROGATE_KEY).drop("n_entities")
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("bigint"))) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into windows, with their ids."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", surrogates),
    ("packing", packed),
]
ORACLE_SQL = None  # compression, sampling, keyed hashes and retrieval have no SQL; tests/llm/test_pipeline.py holds it against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder and read again."""
    docs = _documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = store.kept(stage(spark, docs, sf_dir), name)
    return docs
