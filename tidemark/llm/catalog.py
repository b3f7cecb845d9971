"""The registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import align, decontaminate, idfile, language, leaks, lengths, near, packing, pii, repeats, repair, store, topk, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
runs AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS win
  FROM (SELECT d.*, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, k, n, item_id FROM runs JOIN windows USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM hits) GROUP BY 1),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS sha FROM hits GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)"""



def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(_table(spark, sf_dir, "documents")).drop("removed")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(_table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored) WHERE rank <= 20"""


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    samples = language.dictionaries(docs.where(~F.coalesce(held_out, F.lit(False))))
    return language.identify(docs, samples).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write(_table(spark, sf_dir, "pages"), store.new_folder(spark, "warc"))
    return warc.read(manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid")


_BASE32 = "list_aggregate(list_transform(range(0, 8), lambda k: list_aggregate(list_transform(range(0, 4), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha1(html), 5 * k + 1, 5))::BIGINT >> (15 - 5 * j)) & 31)::INTEGER + 1, 1)), 'string_agg', '')), 'string_agg', '')"
OP5_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS least FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> least THEN least END AS refers_to, true AS valid FROM f"""


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = idfile.write(_table(spark, sf_dir, "documents"), store.new_folder(spark, "ids"))
    return idfile.read(manifest).withColumnRenamed("key", "doc_id")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.classes(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.suffix_sums(lengths.lengths(_table(spark, sf_dir, "documents")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


SURROGATE_KEY = "op10"  # a deployment passes its own secret


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.anonymised(_table(spark, sf_dir, "documents"), SURROGATE_KEY).select("doc_id", "n_entities", "text")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.find(_table(spark, sf_dir, "documents"))
    known = F.filter("spans", lambda s: s["kind"].isin(*leaks.KNOWN))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}") for k in leaks.KNOWN]
    return found.select("doc_id", *counts, F.sha2(leaks.joined(known), 256).alias("base_sha256"), leaks.joined(F.col("spans")).alias("spans"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align.aligned(_table(spark, sf_dir, "documents"), with_groups=False)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    found = repair.repaired(repair.damaged(rows))
    digest = found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    every = rows.select(F.col("conv_id").alias("id")).distinct()
    out = every.join(digest, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    zeros = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(
        F.col("id").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


QUERIES = {
    "op1_decontaminate": op1_decontaminate, "op2_repeats": op2_repeats, "op3_topk": op3_topk, "op4_language": op4_language, "op5_warc": op5_warc,
    "op6_token_ids": op6_token_ids, "op7_near_duplicates": op7_near_duplicates, "op8_token_counts": op8_token_counts, "op9_packing": op9_packing,
    "op10_surrogates": op10_surrogates, "op11_secrets": op11_secrets, "op12_alignment": op12_alignment, "op13_repair": op13_repair,
}
ORACLES = {"op1_decontaminate": OP1_SQL, "op3_topk": OP3_SQL, "op5_warc": OP5_SQL}
