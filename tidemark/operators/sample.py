"""Deterministic sampling: order by the hash of the row key, exact sizes, no row order needed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.columns import gaussian, hash_hex, hash_int, key_text
from tidemark.operators.scan import BY_SIZE, numbered

SMALL_SAMPLE = 1_000  # a top-k this small merges cheaply even from very many tasks
# The first primes beyond 10**12; universes are smaller.
STRIDES = [10**12 + k for k in (39, 61, 63, 91, 121, 163, 169, 177)]


def hash_quota(df: DataFrame, row_key: Sequence[str], seed: int, by: Sequence[str], quotas: DataFrame) -> DataFrame:
    """Per group the ``quota`` rows with the smallest hash, exactly.

    Hash prefixes are counted first (at most 65,536 per group); whole prefixes below the quota pass
    without sorting and only the prefix that crosses it is ranked.
    """
    h = hash_hex(row_key, seed)
    rows = df.withColumn("__h", h).withColumn("__b", F.substring("__h", 1, 4))
    counts = rows.groupBy(*by, "__b").agg(F.count("*").alias("__n"))
    w = W.partitionBy(*by).orderBy("__b").rowsBetween(W.unboundedPreceding, 0)
    upto = counts.withColumn("__upto", F.sum("__n").over(w))
    upto = upto.join(quotas, list(by)) if by else upto.withColumn("quota", quotas.scalar())
    marks = upto.where(F.col("__upto") - F.col("__n") < F.col("quota")).select(
        *by, "__b", (F.col("quota") - F.col("__upto") + F.col("__n")).alias("__room"), (F.col("__upto") <= F.col("quota")).alias("__whole")
    )
    marked = rows.join(marks, [*by, "__b"])
    whole = marked.where(F.col("__whole"))
    edge = numbered(marked.where(~F.col("__whole")), list(by), [F.col("__h"), *row_key], "__rank", splits=BY_SIZE)
    edge = edge.where(F.col("__rank") <= F.col("__room"))
    return whole.select(*df.columns).unionByName(edge.select(*df.columns))


def hash_sample(df: DataFrame, n: int, row_key: Sequence[str], seed: int) -> DataFrame:
    """Exactly ``n`` rows (all rows if fewer), the same whatever the partitioning."""
    if n <= SMALL_SAMPLE:
        return df.orderBy(hash_hex(row_key, seed), *row_key).limit(n)
    quota = df.sparkSession.range(1).select(F.lit(n).cast("bigint").alias("quota"))
    return hash_quota(df, row_key, seed, [], quota)


def stratified_sample(df: DataFrame, n: int, label: str, row_key: Sequence[str], seed: int) -> DataFrame:
    """Per class ``max(1, round(n * share))`` rows, then trimmed to ``n``."""
    total = df.where(F.col(label).isNotNull()).agg(F.count("*").alias("n")).scalar()
    sizes = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("__c"))
    quota = F.least(F.greatest(F.lit(1), F.rint(F.lit(float(n)) * F.col("__c") / F.col("__total"))).cast("bigint"), F.col("__c"))
    quotas = sizes.withColumn("__total", total).select(label, quota.alias("quota"))
    return hash_sample(hash_quota(df.where(F.col(label).isNotNull()), row_key, seed, [label], quotas), n, row_key, seed)


def group_split(df: DataFrame, group: Sequence[str], test_percent: int, seed: int) -> DataFrame:
    """Add ``is_test``; whole groups land on one side."""
    return df.withColumn("is_test", (hash_int(key_text(group, seed)) % 100 < test_percent).cast("int"))


def random_features(df: DataFrame, n: int, row_key: Sequence[str], seed: int, split: str = "train") -> DataFrame:
    """``n`` Gaussian control columns tied to the row key, different per split."""
    return df.select("*", *[gaussian(row_key, seed, split, j).alias(f"random_{j}") for j in range(n)])


def with_row_id(df: DataFrame, order: Sequence[str], name: str = "row_id", splits: int = BY_SIZE) -> DataFrame:
    """Row number over a total order, for tables without a key (sliced, so no single sorting task)."""
    return numbered(df, [], [F.col(c) for c in order], name, splits=splits)


def candidate_pairs(
    positives: DataFrame,
    universe: DataFrame,
    *,
    row_key: Sequence[str],
    items: str,
    universe_item: str,
    seed: int,
    negatives_per_positive: int = 1,
) -> DataFrame:
    """(row_key, candidate, label): every positive, and ``max(1, n_pos * r)`` distinct negatives per row.

    The universe is put on a circle in hash order. A row walks it from its own hashed start in long strides,
    one of eight, for ``n_pos + n_neg`` steps. A stride shares no factor with the circle's size, so the steps
    are distinct and always hold enough items outside its positives if the universe does: no redraw is needed,
    and rows that start close to each other soon part.
    """
    rows = positives.select(*row_key, F.array_compact(F.coalesce(F.col(items), F.array().cast("array<bigint>"))).alias("__pos"))
    pos = rows.select(*row_key, F.explode("__pos").alias("candidate"))
    distinct = universe.select(F.col(universe_item).alias("candidate")).where(F.col("candidate").isNotNull()).distinct()
    placed = numbered(
        distinct, [], [F.md5(F.concat_ws("~", F.col("candidate").cast("string"), F.lit(str(seed)))), F.col("candidate")],
        "__i", splits=BY_SIZE,
    ).withColumn("__i", F.col("__i") - 1)
    size = distinct.agg(F.count("*").alias("n")).scalar()
    wanted = F.greatest(F.lit(1), F.size("__pos") * negatives_per_positive)
    steps: Column = F.least(F.size(F.array_distinct("__pos")) + F.col("__want"), F.col("__size"))
    digest = F.md5(key_text(row_key, seed))
    start = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    stride = F.element_at(F.array(*[F.lit(p) for p in STRIDES]), F.conv(F.substring(digest, 16, 1), 16, 10).cast("int") % len(STRIDES) + 1)
    walk = (
        rows.withColumn("__want", wanted.cast("bigint"))
        .withColumn("__size", size)
        .where(F.col("__size") > 0)
        .select(*row_key, "__want", "__size", F.explode(F.sequence(F.lit(0).cast("bigint"), steps - 1)).alias("__j"))
        .withColumn("__i", (start % F.col("__size") + F.col("__j") * (stride % F.col("__size"))) % F.col("__size"))
    )
    drawn = walk.join(placed, "__i").join(pos, [*row_key, "candidate"], "left_anti")
    w = W.partitionBy(*row_key).orderBy("__j")
    neg = drawn.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= F.col("__want"))
    return pos.withColumn("label", F.lit(1)).unionByName(neg.select(*row_key, "candidate", F.lit(0).alias("label")))
