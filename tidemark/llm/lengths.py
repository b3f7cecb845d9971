"""Exact histogram of encoded document lengths, and the answers its suffix sums give for any context limit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.batches import mapped

BLOCK = 256  # lengths per block of the suffix sums


def lengths(docs: DataFrame, *, text: str = "text", vocabulary: str = tokens.BYTE_BPE, end_ids: int = 0) -> DataFrame:
    """(n_tokens, n_docs): documents by encoded length; counts are summed within each task before the shuffle.

    A null or empty text has ``end_ids`` tokens. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.encoder(vocabulary)
        for batch in batches:
            n, count = np.unique(coder.lengths(batch["text"].to_pylist()) + end_ids, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(count.astype(np.int64))], names=["n_tokens", "n_docs"])

    return mapped(docs.select(F.col(text).alias("text")), run, "n_tokens bigint, n_docs bigint").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Per length that occurs, read as a context limit: n_docs of exactly it; docs_at_least and tokens_at_least
    of it or more; truncated_tokens if every document is cut to it; quantile, the share of documents that
    fit; kept_share of all tokens. An empty histogram gives no rows.

    Sums run in two levels, within blocks of lengths and over block totals, so no task holds all lengths.
    """
    rows = histogram.withColumns({"block": F.expr(f"n_tokens div {BLOCK}"), "tokens": F.col("n_tokens") * F.col("n_docs")})
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("later_d"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("later_t"),
        F.sum("d").over(everything).alias("total_docs"), F.sum("t").over(everything).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc())
    out = rows.join(blocks, "block").select(
        "n_tokens", "n_docs", (F.sum("n_docs").over(inside) + F.col("later_d")).alias("docs_at_least"),
        (F.sum("tokens").over(inside) + F.col("later_t")).alias("tokens_at_least"), "total_docs", "total_tokens",
    )
    cut = F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    return out.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least", cut.alias("truncated_tokens"), "total_docs", "total_tokens",
        (1 - (F.col("docs_at_least") - F.col("n_docs")) / F.col("total_docs")).alias("quantile"),
        F.when(F.col("total_tokens") > 0, cut / F.col("total_tokens")).otherwise(1.0).alias("kept_share"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_over, truncated_tokens, lost_tokens) for any limits, whether such a length occurs or not."""
    n, limit = F.col("n_tokens"), F.col("context_limit")
    return (
        histogram.withColumn("context_limit", F.explode(F.array(*[F.lit(x).cast("bigint") for x in sorted(set(limits))])))
        .groupBy("context_limit")
        .agg(
            F.sum(F.when(n > limit, F.col("n_docs")).otherwise(0)).alias("docs_over"),
            F.sum(F.least(n, limit) * F.col("n_docs")).alias("truncated_tokens"),
            F.sum(F.greatest(n - limit, F.lit(0)) * F.col("n_docs")).alias("lost_tokens"),
        )
    )


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least that share of the documents does not exceed."""
    found = suffix_sums(histogram).where(F.col("n_docs") > 0)
    wanted = found.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in sorted(set(shares))])))
    return wanted.where(F.col("quantile") >= F.col("share") - 1e-12).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
