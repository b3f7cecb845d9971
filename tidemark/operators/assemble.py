"""Joining feature blocks by row key, choosing columns, comparing matrices."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.columns import require_columns
from tidemark.operators.scan import first_row, numbered
from tidemark.session import ensure_checkpoint_dir


def assemble_blocks(base: DataFrame, blocks: Sequence[DataFrame], row_key: Sequence[str]) -> DataFrame:
    """Left join of per-row feature blocks; feature names must not overlap, and a repeated key in a block is an error."""
    taken = set(base.columns)
    for b in blocks:
        clash = (set(b.columns) - set(row_key)) & taken
        if clash:
            raise ValueError(f"overlapping feature columns {sorted(clash)}")
        taken |= set(b.columns)
    return reduce(lambda a, b: a.join(_one_row_per_key(b, row_key), list(row_key), "left"), blocks, base)


def _one_row_per_key(block: DataFrame, row_key: Sequence[str]) -> DataFrame:
    """The block itself; reading any feature of a repeated key fails. Shuffles on the key the join needs anyway."""
    features = [c for c in block.columns if c not in row_key]
    if not features:
        return block.distinct()
    told = F.concat(F.lit("repeated row key in a feature block: "), F.concat_ws(", ", *[F.col(c).cast("string") for c in row_key]))
    rows = block.groupBy(*row_key).agg(F.count("*").alias("__n"), F.first(F.struct(*features)).alias("__f"))
    checked = F.when(F.col("__n") == 1, F.col("__f")).otherwise(F.raise_error(told).cast(rows.schema["__f"].dataType))
    return rows.select(*row_key, checked.alias("__f")).select(*row_key, *[F.col(f"__f.{c}").alias(c) for c in features])


def write_block(block: DataFrame, row_key: Sequence[str], name: str, *, buckets: int | None = None) -> DataFrame:
    """The block as a table of the session's catalog, bucketed and sorted by row key in the shared folder.

    A repeated key fails the write: rows of a bucket are sorted for it anyway, so equal keys are neighbours. Blocks written
    with equal ``buckets`` (``spark.sql.shuffle.partitions`` if not given) join without moving again.
    """
    spark = block.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    told = F.concat(F.lit("repeated row key in a feature block: "), F.concat_ws(", ", *[F.col(c).cast("string") for c in row_key]))
    nth = F.row_number().over(W.partitionBy(*row_key).orderBy(*row_key))
    once = F.when(F.col("__nth") == 1, True).otherwise(F.raise_error(told).cast("boolean"))
    checked = block.repartition(buckets, *row_key).withColumn("__nth", nth).where(once).drop("__nth")
    writer = checked.write.bucketBy(buckets, *row_key).sortBy(*row_key).option("path", f"{ensure_checkpoint_dir(spark)}/{table}")
    writer.saveAsTable(table)
    return spark.table(table)


def assemble_written(base: DataFrame, blocks: Sequence[DataFrame], row_key: Sequence[str]) -> DataFrame:
    """Left join of blocks from ``write_block`` to a base from it: one scan per table and merges, no exchange.

    Feature names must not overlap; keys were checked when the blocks were written.
    """
    taken = set(base.columns)
    for b in blocks:
        clash = (set(b.columns) - set(row_key)) & taken
        if clash:
            raise ValueError(f"overlapping feature columns {sorted(clash)}")
        taken |= set(b.columns)
    return reduce(lambda a, b: a.join(b.hint("merge"), list(row_key), "left"), blocks, base)


def row_key_report(base: DataFrame, blocks: Mapping[str, DataFrame], row_key: Sequence[str]) -> DataFrame:
    """Per block: rows, repeated keys, keys unknown to the base; all of the last two must be 0."""
    known = base.select(*row_key).distinct().withColumn("__known", F.lit(1))
    out = []
    for name, b in blocks.items():
        per_key = b.groupBy(*row_key).agg(F.count("*").alias("n")).join(known, list(row_key), "left")
        out.append(
            per_key.agg(
                F.lit(name).alias("block"), F.coalesce(F.sum("n"), F.lit(0)).alias("block_rows"),
                F.count_if(F.col("n") > 1).alias("repeated_keys"), F.count_if(F.col("__known").isNull()).alias("unknown_keys"),
            )
        )
    return reduce(lambda a, b: a.unionByName(b), out)


def merge_disjoint(blocks: Sequence[DataFrame], row_key: Sequence[str]) -> DataFrame:
    """Full outer join of blocks with disjoint feature names."""
    seen: set[str] = set()
    for b in blocks:
        own = set(b.columns) - set(row_key)
        if own & seen:
            raise ValueError(f"overlapping feature columns {sorted(own & seen)}")
        seen |= own
    return reduce(lambda a, b: a.join(b, list(row_key), "full_outer"), blocks)


def append_new_columns(left: DataFrame, right: DataFrame, row_key: Sequence[str], tag: str = "__dmax2", only_new: bool = True) -> DataFrame:
    """Columns of ``right`` by row key; clashes are left out, or renamed with ``tag``."""
    have = set(left.columns)
    cols = []
    for c in right.columns:
        if c in row_key:
            continue
        if c not in have:
            cols.append(F.col(c))
        elif not only_new:
            cols.append(F.col(c).alias(f"{c}{tag}"))
    return left.join(right.select(*row_key, *cols), list(row_key), "left")


def with_occurrence(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "occurrence") -> DataFrame:
    """0-based number of a row within its key, by a total order."""
    return numbered(df, keys, [F.col(c) for c in order], name).withColumn(name, F.col(name) - 1)


def occurrence_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: Sequence[str], right_order: Sequence[str]
) -> DataFrame:
    """Left join on repeated keys that stays one-to-one: the i-th row meets the i-th row."""
    a = with_occurrence(left, keys, left_order)
    b = with_occurrence(right, keys, right_order)
    return a.join(b, [*keys, "occurrence"], "left")


def pull_up(
    target: DataFrame, parent: DataFrame, *, key: str, parent_key: str, columns: Sequence[str],
    order: Sequence[str] = (), drop: Sequence[str] = (), suffix: str = "_parent",
) -> DataFrame:
    """Attach parent attributes (one row per parent key), suffix on clash, drop unwanted columns."""
    one = first_row(parent.select(parent_key, *columns), [parent_key], list(order) or list(columns))
    named = one.select(
        F.col(parent_key).alias("__pk"), *[F.col(c).alias(c + suffix if c in target.columns else c) for c in columns]
    )
    return target.join(named, target[key] == F.col("__pk"), "left").drop("__pk", *drop)


def enrich_key(target: DataFrame, source: DataFrame, *, key: str, source_pk: str, columns: Sequence[str]) -> DataFrame:
    """Attach columns of ``source`` through its primary key."""
    named = source.select(F.col(source_pk).alias("__pk"), *columns)
    return target.join(named, target[key] == F.col("__pk"), "left").drop("__pk")


def enrich_check(enriched: DataFrame, agree: Sequence[tuple[str, str]], required: str) -> DataFrame:
    """One row: rows, rows without the attached key, and disagreements per column pair (NULL-safe)."""
    return enriched.agg(
        F.count("*").alias("n_rows"), F.count_if(F.col(required).isNull()).alias("unmatched"),
        *[F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias(f"differs_{a}") for a, b in agree],
    )


def require_agreement(check: DataFrame) -> None:
    """Fail when an enrichment check reports any unmatched or disagreeing row."""
    row = check.first().asDict()
    bad = {k: v for k, v in row.items() if k != "n_rows" and v}
    if bad:
        raise ValueError(f"key enrichment does not verify: {bad}")


def compare_matrices(a: DataFrame, b: DataFrame, row_key: Sequence[str]) -> DataFrame:
    """(column, differing_rows) over shared columns, with row-level presence; one join, one aggregate."""
    shared = [c for c in a.columns if c in set(b.columns) and c not in row_key]
    left = a.select(*row_key, *[F.col(c).alias(f"__a_{i}") for i, c in enumerate(shared)], F.lit(1).alias("__in_a"))
    right = b.select(*row_key, *[F.col(c).alias(f"__b_{i}") for i, c in enumerate(shared)], F.lit(1).alias("__in_b"))
    joined = left.join(right, list(row_key), "full_outer")
    both = F.col("__in_a").isNotNull() & F.col("__in_b").isNotNull()
    wide = joined.agg(
        F.count_if(F.col("__in_b").isNull()).alias("only_a"), F.count_if(F.col("__in_a").isNull()).alias("only_b"),
        *[F.count_if(both & ~F.col(f"__a_{i}").eqNullSafe(F.col(f"__b_{i}"))).alias(f"d_{i}") for i in range(len(shared))],
    )
    rows = [F.struct(F.lit("<rows only left>").alias("column"), F.col("only_a").alias("differing_rows")),
            F.struct(F.lit("<rows only right>").alias("column"), F.col("only_b").alias("differing_rows"))]
    rows += [F.struct(F.lit(c).alias("column"), F.col(f"d_{i}").alias("differing_rows")) for i, c in enumerate(shared)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def column_difference(a: DataFrame, b: DataFrame) -> dict[str, list[str]]:
    """Columns only in one of two matrices."""
    return {
        "only_left": [c for c in a.columns if c not in set(b.columns)],
        "only_right": [c for c in b.columns if c not in set(a.columns)],
    }


def split_residual(combined: DataFrame, residual: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(baseline, candidate) out of one matrix; every residual column must exist."""
    require_columns(combined, residual, "combined matrix")
    return combined.drop(*residual), combined


def add_aliases(df: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """Copy source columns under further names unless these exist already."""
    require_columns(df, [s for n, s in aliases.items() if n not in df.columns])
    return df.select("*", *[F.col(s).alias(n) for n, s in aliases.items() if n not in df.columns])


# Name patterns of the columns that this library's operators make, by their default prefixes.
DEPENDENCY_PATTERNS = [r"^f_amb__", r"^hop2_"]
COLUMN_BLOCKS = {
    "ambiguity": [r"^f_amb__"],
    "two_hop": [r"^hop2_"],
    "last_only": [r"last_value", r"latest"],
    "history_only": [r"all_past"],
    "recency_only": [r"recent_\d+d", r"since_last"],
    "trend_only": [r"trend_"],
}


def columns_of_block(columns: Sequence[str], block: str, keep: Sequence[str] = ()) -> list[str]:
    """Column names of one block, plus ``keep``; ``fk_aggregation`` is all but the dependency columns."""
    if block == "fk_aggregation":
        bad = re.compile("|".join(DEPENDENCY_PATTERNS), re.IGNORECASE)
        return [c for c in columns if c in keep or not bad.search(c)]
    good = re.compile("|".join(COLUMN_BLOCKS[block]), re.IGNORECASE)
    return [c for c in columns if c in keep or good.search(c)]


def random_columns(columns: Sequence[str], k: int, seed: int) -> list[str]:
    """``k`` names in the order of the MD5 of name and seed."""
    return sorted(columns, key=lambda c: hashlib.md5(f"{c}~{seed}".encode()).hexdigest())[:k]


def nested_budgets(ranked: Sequence[str], budgets: Sequence[int], columns: Sequence[str]) -> dict[int, list[str]]:
    """Prefix sets of a ranking; each value column brings its missing flag along."""
    have = set(columns)
    out = {}
    for k in budgets:
        chosen = list(ranked[:k])
        out[k] = chosen + [f"{c}__is_missing" for c in chosen if f"{c}__is_missing" in have]
    return out


def apply_decision(outcome: str, baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Exact fallback: the untouched baseline unless the candidate was selected."""
    if outcome not in ("SELECT", "FALLBACK"):
        raise ValueError(f"unknown outcome {outcome!r}")
    return candidate if outcome == "SELECT" else baseline


def column_fingerprints(matrix: DataFrame, row_key: Sequence[str]) -> DataFrame:
    """Per column: rows, non-null values, and a fingerprint of its multiset of (row key, value), from one pass.

    Order, partitioning and column order don't matter; a value that moves to another row does. Any type but map has one.
    """
    key = [F.col(k) for k in row_key]
    hashed = matrix.select(*[F.xxhash64(F.lit(c), *key, F.col(f"`{c}`"), F.col(f"`{c}`").isNull()).alias(f"h{i}") for i, c in enumerate(matrix.columns)], *[
        F.col(f"`{c}`").isNotNull().alias(f"k{i}") for i, c in enumerate(matrix.columns)
    ])
    span = range(len(matrix.columns))
    sums = hashed.agg(F.count("*").alias("n"), *[e for i in span for e in (
        F.count_if(f"k{i}").alias(f"n{i}"), F.bit_xor(f"h{i}").alias(f"x{i}"), F.sum(F.pmod(f"h{i}", F.lit(1_000_003))).alias(f"s{i}")
    )])
    rows = [F.struct(
        F.lit(c).alias("column"), F.col("n").alias("n_rows"), F.col(f"n{i}").alias("n_values"), F.col(f"x{i}").alias("hash_xor"), F.col(f"s{i}").alias("hash_sum"),
    ) for i, c in enumerate(matrix.columns)]
    return sums.select(F.inline(F.array(*rows)))


def fallback_proof(baseline: DataFrame, chosen: DataFrame, row_key: Sequence[str]) -> DataFrame:
    """(column, in_baseline, in_chosen, same): after a fallback every column is in both and the same, value by value and row by row.

    Each matrix is read once; no row of one meets a row of the other.
    """
    parts = [column_fingerprints(m, row_key).select("column", F.struct("n_rows", "n_values", "hash_xor", "hash_sum").alias(side)) for m, side in ((baseline, "b"), (chosen, "c"))]
    both = parts[0].join(parts[1], "column", "full_outer")
    return both.select("column", F.col("b").isNotNull().alias("in_baseline"), F.col("c").isNotNull().alias("in_chosen"), F.coalesce(F.col("b") == F.col("c"), F.lit(False)).alias("same"))


def feature_manifest(matrix: DataFrame, programs: DataFrame) -> DataFrame:
    """Feature programs with a flag saying whether the matrix holds the column.

    ``programs`` has feature, block, path and temporal predicate, one row per feature.
    """
    spark = matrix.sparkSession
    names = spark.createDataFrame([(c,) for c in matrix.columns], "feature string").withColumn("__has", F.lit(1))
    return programs.join(F.broadcast(names), "feature", "left").withColumn(
        "materialised", F.col("__has").isNotNull()
    ).drop("__has")
