"""Running states over ordered groups that stay balanced when one group holds most rows.

A plain ``Window.partitionBy(key).orderBy(t)`` puts a whole key into one task. ``prefix_scan`` cuts
the order axis into slices first: each (key, slice) is one window group, slice totals are scanned per
key over at most ``splits`` rows, and the carry of earlier slices is joined back. States are sums,
maxima or minima, so both levels combine exactly.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS_PER_TASK = 2_000_000
SHUFFLE_ROWS = 250_000
SHUFFLE_BYTES = 8 << 20  # what adaptive execution may merge into one partition; a compressed row can be 10 bytes, in memory 400
BY_SIZE = 0  # as a number of slices: as many as keep a slice at about ROWS_PER_TASK rows
SLICE = "__slice"


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a table whose row count is bounded by a driver-side constant."""
    if rows > 100_000:
        return df
    return F.broadcast(df)


def _bytes(size: str) -> int:
    """A size as Spark's settings write it: 64MB, 8m, 67108864b."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def deal_shuffles(spark: SparkSession, rows: int) -> None:
    """Let shuffles of about ``rows`` rows start with partitions of SHUFFLE_ROWS, so that a task's memory stays level.

    Only raises the session's number, and lowers to SHUFFLE_BYTES what adaptive execution merges into one partition:
    its own 64 MB are compressed bytes, which can hold millions of rows.
    """
    name, merged = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    now = int(spark.conf.get(name, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    if rows > now * SHUFFLE_ROWS:
        spark.conf.set(name, str(-(-rows // SHUFFLE_ROWS)))
    if rows > SHUFFLE_ROWS and _bytes(spark.conf.get(merged)) > SHUFFLE_BYTES:
        spark.conf.set(merged, f"{SHUFFLE_BYTES}b")


def measure_groups(
    *sides: tuple[DataFrame, Sequence[str], str], rows_per_task: int = ROWS_PER_TASK, copies: int = 1
) -> tuple[int, dict[str, int]]:
    """(splits, largest group per key domain): 1 split if every group fits one task, else BY_SIZE.

    A side is (base table, key columns, key domain); sides of one domain add up per key. Pass base
    tables, not derived ones: each table is read once, column-pruned, and counts combine map-side; one row
    per domain reaches the driver. ``copies`` says how often a row is shuffled at most, as when it is probed often.
    """
    tables: dict[int, tuple[DataFrame, list[Column]]] = {}
    for df, keys, domain in sides:
        tables.setdefault(id(df), (df, []))[1].append(F.struct(F.lit(domain).alias("d"), F.xxhash64(*keys).alias("h")))
    tagged = [df.select(F.explode(F.array(*tags)).alias("s")).select("s.d", "s.h") for df, tags in tables.values()]
    counts = reduce(lambda a, b: a.unionAll(b), tagged).groupBy("d", "h").count()
    found = counts.groupBy("d").agg(F.max("count").alias("largest"), F.sum("count").alias("rows")).collect()
    deal_shuffles(sides[0][0].sparkSession, copies * sum(r["rows"] for r in found))
    largest = {domain: 0 for _, _, domain in sides} | {r["d"]: r["largest"] for r in found}
    return 1 if all(n <= rows_per_task for n in largest.values()) else BY_SIZE, largest


def choose_splits(*sides: tuple[DataFrame, Sequence[str], str], rows_per_task: int = ROWS_PER_TASK, copies: int = 1) -> int:
    return measure_groups(*sides, rows_per_task=rows_per_task, copies=copies)[0]


def with_slice(rows: DataFrame, order: str, spread_by: Sequence[str], splits: int, marks_from: DataFrame | None = None) -> DataFrame:
    """Add a slice number that is monotone in ``order`` and holds about 1/splits of all rows.

    Boundaries are order values of rows drawn by hash, so they work for any orderable type: ``splits - 1``
    of them, or by size every ROWS_PER_TASK-th, so their number follows the table, and each of several groups
    gets its own share. They only decide where a group is cut, never a result. ``marks_from`` is a cheaper table
    to draw them from (columns ``spread_by`` and ``order``). Lookup is two-step, a square root each.
    """
    drawn = (rows if marks_from is None else marks_from).select(
        F.col(order).alias("v"), F.xxhash64(*spread_by).alias("h")
    ).where(F.col("v").isNotNull())
    if splits == BY_SIZE:
        drawn = drawn.where(F.pmod("h", F.lit(ROWS_PER_TASK)) == 0).select("v").distinct()
    else:
        drawn = drawn.orderBy("h", "v").limit(splits - 1)
    marks = (
        drawn.agg(F.sort_array(F.collect_list("v")).alias("fine"))
        .withColumn("step", F.greatest(F.lit(2), F.floor(F.sqrt(F.size("fine"))).cast("int")))
        .select(F.struct("fine", "step", F.filter("fine", lambda _, i: i % F.col("step") == 0).alias("coarse")).alias("m"))
    )
    step = F.col("__slice_marks.step")
    block = F.size(F.filter(F.col("__slice_marks.coarse"), lambda p: p <= F.col(order)))
    inside = F.size(F.filter(F.slice(F.col("__slice_marks.fine"), (block - 1) * step + 1, step), lambda p: p <= F.col(order)))
    place = F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + inside)
    return rows.withColumn("__slice_marks", marks.scalar()).withColumn(SLICE, place).drop("__slice_marks")


def prefix_scan(
    rows: DataFrame,
    keys: Sequence[str],
    order: str,
    adds: Sequence[str] = (),
    maxes: Sequence[str] = (),
    mins: Sequence[str] = (),
    *,
    splits: int = 1,
    before_current: bool = False,
    reverse: bool = False,
    marks_from: DataFrame | None = None,
) -> DataFrame:
    """Replace each state column by its running value in ``order`` within ``keys`` (keys not null).

    Rows should be unique per (keys, order); callers aggregate first, which also combines map-side.
    ``before_current`` leaves the row itself out; ``reverse`` runs from the far end of the order.
    """
    keys = list(keys)
    states = [*adds, *maxes, *mins]
    last = -1 if before_current else 0
    pick = {**{c: F.sum for c in adds}, **{c: F.max for c in maxes}, **{c: F.min for c in mins}}
    plain = [c for c in rows.columns if c not in pick]

    turn = F.desc if reverse else F.asc

    if splits == 1:
        w = W.partitionBy(*keys).orderBy(turn(order)).rowsBetween(W.unboundedPreceding, last)
        return rows.select(*plain, *[pick[c](c).over(w).alias(c) for c in states])

    cut = with_slice(rows, order, [*keys, order], splits, marks_from)
    w_in = W.partitionBy(*keys, SLICE).orderBy(turn(order)).rowsBetween(W.unboundedPreceding, last)
    inner = cut.select(*plain, SLICE, *[pick[c](c).over(w_in).alias(c) for c in states])
    w_up = W.partitionBy(*keys).orderBy(turn(SLICE)).rowsBetween(W.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, SLICE).agg(*[pick[c](c).alias(c) for c in states])
    carry = totals.select(*keys, SLICE, *[pick[c](c).over(w_up).alias(f"__carry_{c}") for c in states])

    def merged(c: str) -> Column:
        here, earlier = F.col(c), F.col(f"__carry_{c}")
        if c in adds:
            both = F.when(here.isNull(), earlier).when(earlier.isNull(), here).otherwise(here + earlier)
        else:
            both = (F.greatest if c in maxes else F.least)(here, earlier)
        return both.alias(c)

    joined = inner.join(carry, [*keys, SLICE], "left")
    return joined.select(*plain, *[merged(c) for c in states])


def with_neighbours(rows: DataFrame, keys: Sequence[str], order: str, splits: int) -> DataFrame:
    """Add ``__prev`` and ``__next``, the neighbouring order values within ``keys``."""
    if splits == 1:
        w = W.partitionBy(*keys).orderBy(order)
        return rows.select("*", F.lag(order).over(w).alias("__prev"), F.lead(order).over(w).alias("__next"))
    both = rows.distinct().select("*", F.col(order).alias("__prev"), F.col(order).alias("__next"))
    both = prefix_scan(both, keys, order, maxes=["__prev"], splits=splits, before_current=True, marks_from=rows)
    return prefix_scan(both, keys, order, mins=["__next"], splits=splits, before_current=True, reverse=True, marks_from=rows)


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    name: str,
    *,
    splits: int | None = None,
) -> DataFrame:
    """Row number within ``keys`` by a total ``order`` (all ascending), sliced for large groups."""
    ready = df.withColumn("__ord", F.struct(*order)).withColumn(name, F.lit(1).cast("bigint"))
    if splits is None:
        splits = choose_splits((df, keys, "k"))
    return prefix_scan(ready, keys, "__ord", adds=[name], splits=splits).drop("__ord")


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], last: bool = False) -> DataFrame:
    """One whole row per key: the smallest (or largest) by a total order. Combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.max if last else F.min
    best = F.struct(F.struct(*order).alias("o"), F.struct(*rest).alias("r")) if rest else F.struct(F.struct(*order).alias("o"))
    out = df.groupBy(*keys).agg(picked(best).alias("__b"))
    return out.select(*[F.col(c) if c in keys else F.col(f"__b.r.`{c}`").alias(c) for c in df.columns])


def value_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, feature, value, n) of the non-null numeric values of all columns in one pass."""
    long = df.select(*by, *[F.col(c).try_cast("double").alias(c) for c in columns]).unpivot(
        list(by), list(columns), "feature", "value"
    )
    return long.where(F.col("value").isNotNull()).groupBy(*by, "feature", "value").agg(F.count("*").alias("n"))


def exact_medians(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), *, splits: int = BY_SIZE) -> DataFrame:
    """(by, feature, median), exact, from value counts and a sliced running count.

    The built-in exact percentile keeps all distinct values of a group in one buffer; this does not.
    """
    counts = value_counts(df, columns, by)
    groups = [*by, "feature"]
    totals = counts.groupBy(*groups).agg(F.sum("n").alias("__total"))
    upto = prefix_scan(counts, groups, "value", adds=["n"], splits=splits)
    ranked = upto.join(bounded(totals, len(columns)) if not by else totals, groups)
    low = (F.col("__total") + 1).cast("bigint")
    low = F.floor(low / 2)
    high = F.floor(F.col("__total") / 2) + 1
    return ranked.groupBy(*groups).agg(
        (
            (F.min(F.when(F.col("n") >= low, F.col("value"))) + F.min(F.when(F.col("n") >= high, F.col("value"))))
            / F.lit(2.0)
        ).alias("median")
    )
