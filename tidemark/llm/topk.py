"""Exact top-k inner-product search: a grid of query blocks and vector shards, and a tree of merges.

Vectors are dealt by hash into shards and queries into blocks, both of bounded size; each cell of the grid
multiplies its two matrices tile by tile, keeps the k best per query of every tile by partial selection and
returns one short list per query. Lists of eight shards at a time are merged until one is left, so no task
sees more than 8 k entries of a query.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_ROWS, BLOCK_ROWS = 16_384, 4_096
TILE_QUERIES, TILE_VECTORS = 512, 8_192
FAN_IN = 8
_NONE = np.iinfo(np.int64).min


def quantised(df: DataFrame, id_column: str, vector: str, scale: float) -> DataFrame:
    """(vec_id, v): distinct usable rows, each component x as floor(scale * x) with x as double.

    Rows whose id or vector is null, or that hold a null, infinite or NaN component, take no part. Repeated
    rows (same id and same vector) count once.
    """
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    usable = F.col(vector).isNotNull() & F.col(id_column).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(F.coalesce(usable, F.lit(False))).select(F.col(id_column).cast("bigint").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v")).distinct()


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten(), dtype=np.int64).reshape(len(flat), -1)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k greatest values, greatest first; smaller columns win ties."""
    n = scores.shape[1]
    low, high = int(scores[scores > _NONE].min(initial=0)), int(scores.max(initial=0))
    if max(abs(low), abs(high)) >= (1 << 62) // max(n, 1):  # too large for the joint key below
        return np.argsort(np.where(scores > _NONE, -scores, -(_NONE + 1)), axis=1, kind="stable")[:, :k]
    joint = np.where(scores > _NONE, scores * n - np.arange(n), _NONE)
    if n > k:
        some = np.argpartition(joint, n - k, axis=1)[:, n - k :]
    else:
        some = np.broadcast_to(np.arange(n), scores.shape)
    order = np.argsort(np.take_along_axis(joint, some, 1), axis=1)[:, ::-1]
    return np.take_along_axis(some, order, 1)


def _cell(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("q_hash", pa.int64()), ("node", pa.int64()), ("score", pa.list_(pa.int64())), ("vec_id", pa.list_(pa.int64()))])

    def run(key: tuple, q: pa.Table, v: pa.Table) -> pa.Table:
        if not q.num_rows or not v.num_rows:
            return schema.empty_table()
        v = v.sort_by("cand_id")
        ids, vectors = v["cand_id"].to_numpy(), _matrix(v["cand"])
        query_ids, queries = q["vec_id"].to_numpy(), _matrix(q["v"])
        largest = float(np.abs(vectors.astype(float)).max(initial=0)) * float(np.abs(queries.astype(float)).max(initial=0)) * max(1, vectors.shape[1])
        kind = np.float64 if largest < 2**53 else np.int64  # doubles are exact up to there
        vectors, queries = vectors.astype(kind), queries.astype(kind)
        all_scores, all_ids = [], []
        for a in range(0, len(queries), TILE_QUERIES):
            own = query_ids[a : a + TILE_QUERIES]
            top_s = np.full((len(own), 0), _NONE)
            top_i = np.zeros((len(own), 0), np.int64)
            for b in range(0, len(vectors), TILE_VECTORS):
                tile_ids = ids[b : b + TILE_VECTORS]
                s = (queries[a : a + TILE_QUERIES] @ vectors[b : b + TILE_VECTORS].T).astype(np.int64)
                lo, hi = np.searchsorted(tile_ids, own, "left"), np.searchsorted(tile_ids, own, "right")
                for row in np.flatnonzero(hi > lo):
                    s[row, lo[row] : hi[row]] = _NONE  # a query isn't its own neighbour
                some = _best(s, k)
                # earlier tiles have smaller ids and stand first, so ties still go to the smaller id
                s, i = np.concatenate([top_s, np.take_along_axis(s, some, 1)], 1), np.concatenate([top_i, tile_ids[some]], 1)
                some = _best(s, k)
                top_s, top_i = np.take_along_axis(s, some, 1), np.take_along_axis(i, some, 1)
            for s, i in zip(top_s, top_i, strict=True):
                kept = s > _NONE
                all_scores.append(s[kept])
                all_ids.append(i[kept])
        return pa.table([q["vec_id"], q["q_hash"], pa.array(np.full(len(queries), key[1].as_py())), pa.array(all_scores, pa.list_(pa.int64())), pa.array(all_ids, pa.list_(pa.int64()))], schema=schema)

    return run


def nearest(df: DataFrame, k: int = 20, *, id_column: str = "vec_id", vector: str = "embedding", scale: float = 64.0, every: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best candidates of every row whose id is divisible by ``every``.

    Candidates are all rows with another id and a vector of the same length; ties go to the smaller id.
    A query id with several different vectors is searched for each of them. Without candidates a query has no
    rows. Products beyond 2**53 are computed in 64-bit integers; beyond 2**63 they wrap.
    """
    rows = quantised(df, id_column, vector, scale).withColumn("size", F.size("v"))
    queries = rows.where(F.col("vec_id") % every == 0).withColumn("q_hash", F.xxhash64("v"))
    n = rows.groupBy().agg(F.count("*").alias("n"), F.sum((F.col("vec_id") % every == 0).cast("bigint")).alias("q")).first()
    shards, blocks = max(1, ceil(n["n"] / SHARD_ROWS)), max(1, ceil((n["q"] or 0) / BLOCK_ROWS))
    deal = lambda parts: F.pmod(F.xxhash64("vec_id", "v", F.lit(7)), F.lit(parts))
    spread = lambda d, name, parts: d.withColumn(name, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    q = spread(queries.withColumn("block", deal(blocks)), "shard", shards)
    v = spread(rows.withColumn("shard", deal(shards)), "block", blocks)
    # both sides come from the same rows: new names keep the columns of the two apart
    v = v.select(F.col("size").alias("s"), F.col("shard").alias("sh"), F.col("block").alias("bl"), F.col("vec_id").alias("cand_id"), F.col("v").alias("cand"))
    lists = q.groupBy("size", "shard", "block").cogroup(v.groupBy("s", "sh", "bl")).applyInArrow(_cell(k), "query_id bigint, q_hash bigint, node bigint, score array<bigint>, vec_id array<bigint>")
    top = lists.select("query_id", "q_hash", "node", F.transform(F.arrays_zip("score", "vec_id"), lambda x: F.struct((-x.score).alias("less"), x.vec_id.alias("vec_id"))).alias("top"))
    while shards > 1:
        shards = ceil(shards / FAN_IN)
        merged = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k)
        top = top.groupBy("query_id", "q_hash", F.expr(f"node div {FAN_IN}").alias("node")).agg(merged.alias("top"))
    out = top.select("query_id", F.posexplode("top"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col.vec_id").alias("vec_id"), (-F.col("col.less")).alias("score"))
