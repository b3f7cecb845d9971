"""Exact and approximate functional dependencies: profiles, edges, ambiguity features."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import as_time, poisson_weight, require_columns, sigmoid, symbol, xlogx
from tidemark.operators.scan import ROWS_PER_TASK, bounded, deal_shuffles, first_row
from tidemark.operators.temporal import as_of_state, effective
from tidemark.sources.tables import written_once

PAIR = ["lhs", "rhs"]


def train_visible_rows(
    entity: DataFrame,
    train: DataFrame,
    *,
    entity_key: str,
    target_key: str,
    entity_time: str | None = None,
    target_time: str | None = None,
) -> DataFrame:
    """Entity rows a training split may see: known entities, up to each entity's last train cutoff."""
    if (entity_time is None) != (target_time is None):
        raise ValueError("entity_time and target_time must either both be provided or both be omitted")
    require_columns(entity, [entity_key] + ([entity_time] if entity_time else []), "entity")
    require_columns(train, [target_key] + ([target_time] if target_time else []), "train")
    known = train.where(F.col(target_key).isNotNull())
    if entity_time is None:
        keys = known.select(F.col(target_key).alias(entity_key)).distinct()
        return entity.join(keys, entity_key, "left_semi")
    last = known.groupBy(F.col(target_key).alias(entity_key)).agg(F.max(as_time(train, target_time)).alias("__last"))
    return (
        entity.join(last, entity_key)
        .where(as_time(entity, entity_time) <= F.col("__last"))
        .select(*entity.columns)
    )


def fit_manifest(entity: DataFrame, train: DataFrame, fit: DataFrame, *, entity_key: str, target_key: str, entity_time: str | None = None) -> DataFrame:
    """One row: source rows, train entities, fit rows, fit entities, last fit time."""
    last = F.max(as_time(fit, entity_time)) if entity_time else F.lit(None).cast("timestamp_ntz")
    out = fit.agg(
        F.count("*").alias("fit_rows"), F.count_distinct(entity_key).alias("fit_entities"), last.alias("fit_max_time")
    )
    return out.withColumn("source_rows", entity.agg(F.count("*").alias("n")).scalar()).withColumn(
        "train_entities", train.agg(F.count_distinct(target_key).alias("n")).scalar()
    )


def require_rows(fit: DataFrame) -> DataFrame:
    """Fail early when no entity row is visible to training."""
    if not fit.limit(1).collect():
        raise ValueError("fit table is empty")
    return fit


LIGHT_ROWS = 8  # rows there must be for each possible value pair, if the pair's counts are to combine in the map tasks
LIGHT_CELLS = 1 << 16  # or as few value pairs as fit any task
WIDE_VALUES = 1 << 14  # distinct values above which a column's rows are dealt by value


class _Profile(NamedTuple):
    """One column by itself."""

    n: int  # rows that are not null
    distinct: int
    pairs: float  # pairs of rows that agree
    log: float  # sum of n ln n over values
    repeated: int  # rows whose value occurs again
    largest: int  # rows of the most frequent value


def _codes(df: DataFrame, columns: Sequence[str], seed: int) -> list[Column]:
    """A 64-bit code per value. Numbers, dates and times have one each; texts share one only by a clash, which the profile sees."""

    def value(c: str) -> Column:
        return F.col(c) if not _texts(df, c) else symbol(df, c)

    def code(c: str) -> Column:
        if isinstance(df.schema[c].dataType, (T.IntegralType, T.BooleanType)):
            return F.col(c).cast("bigint")  # itself: its leading zeros cost a shuffle nothing
        return F.xxhash64(F.lit(seed), value(c)) if _texts(df, c) else F.xxhash64(value(c))

    return [F.when(F.col(c).isNotNull(), code(c)) for c in columns]


def _texts(df: DataFrame, column: str) -> bool:
    return not isinstance(df.schema[column].dataType, (T.NumericType, T.DatetimeType, T.BooleanType, T.TimestampNTZType)) or isinstance(df.schema[column].dataType, T.DecimalType)


def _profiled(df: DataFrame, columns: Sequence[str], seed: int = 0) -> tuple[int, int, list[_Profile]]:
    """(seed of the codes, rows, profile of each column), from one pass over all columns; a row per column reaches the driver."""
    codes = _codes(df, columns, seed)
    texts = [(x, c) for x, c in zip(codes, columns, strict=True) if _texts(df, c)]
    if texts:  # two texts with one code differ in a second hash
        pairs = df.select(F.posexplode(F.array(*[F.struct(x.alias("x"), F.xxhash64(F.lit(~seed), symbol(df, c)).alias("h")) for x, c in texts])).alias("i", "s"))
        twice = pairs.where("s.x is not null").groupBy("i", "s.x").agg(F.min("s.h").alias("lo"), F.max("s.h").alias("hi")).where("lo <> hi")
        if not twice.isEmpty():
            return _profiled(df, columns, seed + 1)
    values = df.select(F.posexplode(F.array(*codes)).alias("i", "x")).groupBy("i", "x").agg(F.count("*").alias("n"))
    known = F.col("x").isNotNull()
    found = values.groupBy("i").agg(
        F.sum(F.when(known, F.col("n")).otherwise(0)), F.count("x"), *[F.sum(F.when(known, e).otherwise(0)) for e in (pair_count(F.col("n")), xlogx(F.col("n")))],
        F.sum(F.when(known & (F.col("n") > 1), F.col("n")).otherwise(0)), F.coalesce(F.max(F.when(known, F.col("n"))), F.lit(0)), F.sum("n"),
    ).collect()
    by_column = {r[0]: _Profile(*r[1:-1]) for r in found}
    return seed, max((r[-1] for r in found), default=0), [by_column.get(i, _Profile(0, 0, 0.0, 0.0, 0, 0)) for i in range(len(columns))]


def pair_count(n: Column) -> Column:
    n = n.cast("double")
    return n * (n - 1) / 2


def _per_value(cells: DataFrame, weights: Sequence[str]) -> DataFrame:
    """Counts of each left value of each ordered pair, from cells (l, r, x, a, n)."""
    return cells.groupBy("l", "r", "x").agg(
        F.sum("n").alias("n_x"), F.max("n").alias("top"), F.count("*").alias("n_a"), F.sum(xlogx(F.col("n"))).alias("xl"), F.sum(pair_count(F.col("n"))).alias("same"),
        *[F.sum(w).alias(w) for w in weights], *[F.max(w).alias(f"top_{w}") for w in weights],
    )


def _rolled(values: DataFrame, weights: Sequence[str]) -> DataFrame:
    """Sums over the left values of each ordered pair."""
    return values.groupBy("l", "r").agg(
        F.sum("n_x").alias("n"), F.sum("top").alias("kept"),
        F.sum(F.when(F.col("n_a") > 1, F.col("n_x")).otherwise(0)).alias("violating"),
        F.sum(pair_count(F.col("n_x"))).alias("lhs_pairs"), F.sum("same").alias("same_pairs"),
        F.sum(xlogx(F.col("n_x"))).alias("x_log"), F.sum("xl").alias("xa_log"),
        F.count("*").alias("n_lhs"), F.sum(F.when(F.col("n_x") >= 2, F.col("n_x")).otherwise(0)).alias("repeated"),
        *[F.sum(w).alias(f"n_{w}") for w in weights], *[F.sum(f"top_{w}").alias(f"kept_{w}") for w in weights],
        *[F.sum(F.when(F.col(w) >= 2, F.col(w)).otherwise(0)).alias(f"rep_{w}") for w in weights],
        *[F.sum(F.when(F.col(w) >= 1, 1).otherwise(0)).alias(f"uni_{w}") for w in weights],
    )


class _Routes(NamedTuple):
    """How each pair of columns is counted; columns by number."""

    known: list[tuple[int, int]]  # (key, other): the key has no null and no value twice, so profiles say all
    light: list[tuple[int, int]]  # few possible value pairs: counts combine in the map tasks
    dealt: list[tuple[int, int, bool]]  # (by, other, turn): rows are dealt by the values of ``by``; ``turn`` if that also serves other -> by
    narrow: list[int]  # columns that travel with dealt rows as a short number

    @classmethod
    def of(cls, profiles: list[_Profile], rows: int, wanted: set[frozenset[int]], weighted: bool) -> _Routes:
        known, light, heavy = [], [], []
        for i, j in combinations(range(len(profiles)), 2):
            if frozenset((i, j)) not in wanted or not profiles[i].n or not profiles[j].n:
                continue
            keys = [k for k in (i, j) if profiles[k].distinct == rows] if not weighted else []
            if keys:
                known.append((keys[0], i + j - keys[0]))
            elif profiles[i].distinct * profiles[j].distinct * LIGHT_ROWS <= max(rows, LIGHT_CELLS):
                light.append((i, j))
            else:
                heavy.append((i, j))
        wide = {k for pair in heavy for k in pair if profiles[k].distinct > WIDE_VALUES}
        wide |= {max(pair, key=lambda k: profiles[k].distinct) for pair in heavy if not wide & set(pair)}
        # a task's own counts of many value pairs cost more than one more number in a row that is dealt anyway
        riding = [
            p for p in light
            if wide & set(p) and profiles[p[0]].distinct * profiles[p[1]].distinct > LIGHT_CELLS and all(profiles[k].distinct <= WIDE_VALUES for k in set(p) - wide)
        ]
        light, heavy = [p for p in light if p not in riding], heavy + riding
        dealt = [(a, b, b not in wide) for pair in heavy for a, b in (pair, pair[::-1]) if a in wide]
        return cls(known, light, dealt, sorted({b for _, b, turn in dealt if turn}))


def _numbered(df: DataFrame, codes: list[Column], narrow: list[int]) -> DataFrame:
    """(i, x, d): the values of each narrow column numbered from 1, WIDE_VALUES a column at most; written once, read per column."""
    values = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), codes[i].alias("x")) for i in narrow])).alias("s")).select("s.i", "s.x")
    place = F.row_number().over(W.partitionBy("i").orderBy("x")).cast("bigint")
    return written_once(values.where("x is not null").distinct().select("i", "x", place.alias("d")), "numbers")


def _packed(columns: dict[int, Column], distinct: dict[int, int]) -> tuple[list[Column], dict[int, tuple[int, int, int]]]:
    """Numbers from 0 to ``distinct`` side by side in as few longs as hold them, and (long, shift, mask) of each."""
    longs: list[Column] = []
    places, used = {}, 63
    for i, c in columns.items():
        bits = distinct[i].bit_length()
        if used + bits > 62:
            longs.append(F.lit(0).cast("bigint"))
            used = 0
        longs[-1] = longs[-1].bitwiseOR(F.shiftleft(c, used))
        places[i] = (len(longs) - 1, used, (1 << bits) - 1)
        used += bits
    return longs, places


def _pair_table(
    df: DataFrame, columns: Sequence[str], pairs: Sequence[tuple[str, str]], weights: dict[str, Column], rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Sums per ordered column pair. ``weights`` are per-row replicate weights summed beside the plain count.

    One pass profiles the columns; exact distinct counts then settle or bound each pair before any of its value pairs is
    counted. A left or right side that is a key (no null, no value twice) leaves nothing to count. Where the product of the
    distinct counts is far below the rows, value pairs combine in the map tasks. Else rows are dealt once per wide column by
    its value, as codes, and all its pairs are counted where they land: a value's rows lie together like in a position list,
    so neither the counts of its value pairs nor their sums are shuffled again. A value with more than ``rows_per_task`` rows
    isn't dealt; its pairs combine in the map tasks, as few such values can exist. Columns never travel as text: a dealt row
    holds a code for each other wide column, and the narrow ones as numbers of their values side by side in one long.
    """
    seed, rows, profiles = _profiled(df, columns)
    deal_shuffles(df.sparkSession, rows * len(columns))
    number_of = {c: i for i, c in enumerate(columns)}
    routes = _Routes.of(profiles, rows, {frozenset((number_of[a], number_of[b])) for a, b in pairs}, bool(weights))
    k = len(columns)
    codes = _codes(df, columns, seed)
    by = sorted({a for a, _, _ in routes.dealt})
    held = df.select(*[c.alias(f"c{i}") for i, c in enumerate(codes)], *[w.alias(name) for name, w in weights.items()])
    numbers = _numbered(df, codes, routes.narrow) if routes.narrow else None
    for i in routes.narrow:
        own = numbers.where(F.col("i") == i).select(F.col("x").alias(f"c{i}"), F.col("d").alias(f"d{i}"))
        held = held.join(bounded(own, max(profiles[i].distinct, 1)), f"c{i}", "left")
    held = held.select(F.array(*[F.col(f"d{i}" if i in routes.narrow else f"c{i}") for i in range(k)]).alias("c"), *weights)
    hot = [a for a in by if profiles[a].largest > rows_per_task]
    for a in hot:
        most = max(rows // rows_per_task, 1)
        frequent = held.groupBy(F.col("c")[a].alias("v")).count().where((F.col("count") > rows_per_task) & F.col("v").isNotNull()).select("v", F.lit(True).alias(f"hot{a}"))
        held = held.join(bounded(frequent, most), F.col("c")[a] == F.col("v"), "left").drop("v")
    sums = [F.count("*").alias("n"), *[F.sum(w).alias(w) for w in weights]]

    def cells_of(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.where("x is not null and a is not null").groupBy(*keys, "x", "a").agg(*sums)

    def turned(cells: DataFrame) -> DataFrame:
        return cells.select(F.col("r").alias("l"), F.col("l").alias("r"), F.col("a").alias("x"), F.col("x").alias("a"), "n", *weights)

    def number(a: int, b: int, both: bool) -> int:
        return (both * k + a) * k + b

    parts, back = [], []  # counts of left values; cells to be counted by their right values, from wherever they come
    mapped = [F.array(*[F.lit(number(a, b, True)) for a, b in routes.light])] if routes.light else []
    for a in hot:
        own = F.array(*[F.lit(number(a, b, turn)) for by_a, b, turn in routes.dealt if by_a == a])
        mapped.append(F.when(F.col(f"hot{a}"), own).otherwise(F.array().cast("array<int>")))
    if mapped:
        named = held.select("c", F.explode(F.concat(*mapped)).alias("k"), *weights)
        light = cells_of(named.select("k", F.get("c", F.expr(f"(k div {k}) % {k}").cast("int")).alias("x"), F.get("c", F.col("k") % k).alias("a"), *weights), "k")
        light = light.select(F.expr(f"cast((k div {k}) % {k} as int)").alias("l"), (F.col("k") % k).alias("r"), (F.col("k") >= k * k).alias("both"), "x", "a", "n", *weights)
        parts.append(_per_value(light, list(weights)))
        back.append(turned(light.where("both") if hot else light))  # unfiltered, both uses share one shuffle
    if by:
        plan = {a: [(b, turn) for by_a, b, turn in routes.dealt if by_a == a] for a in by}
        longs, places = _packed({i: F.coalesce(F.col("c")[i], F.lit(0)) for i in routes.narrow}, {i: profiles[i].distinct for i in routes.narrow})
        small = [f"__p{i}" for i in range(len(longs))]
        beside = {a: [b for b, turn in plan[a] if not turn] for a in by}  # wide columns whose codes go with a's rows
        large = [f"__w{i}" for i in range(max(map(len, beside.values())))]

        def side(a: int) -> Column:
            x = F.when(~F.coalesce(F.col(f"hot{a}"), F.lit(False)), F.col("c")[a]) if a in hot else F.col("c")[a]
            others = [F.col("c")[b] for b in beside[a]] + [F.lit(None).cast("bigint")] * (len(large) - len(beside[a]))
            return F.struct(F.lit(a).alias("l"), x.alias("x"), *[o.alias(w) for o, w in zip(others, large, strict=True)])

        sides = held.select(F.explode(F.array(*[side(a) for a in by])).alias("s"), *[e.alias(p) for e, p in zip(longs, small, strict=True)], *weights)
        dealt = sides.where("s.x is not null").select("s.l", "s.x", *[f"s.{w}" for w in large], *small, *weights).repartition("l", "x")

        def carried(a: int, b: int) -> Column:
            if b not in places:
                return F.col(large[beside[a].index(b)])
            i, shift, mask = places[b]
            return F.nullif(F.shiftright(small[i], shift).bitwiseAND(F.lit(mask).cast("bigint")), F.lit(0).cast("bigint"))

        # one array for all pairs of a row: both uses of the counts read one shuffle only while they need the same columns
        chosen = F.lit(None).cast("array<struct<r:int,a:bigint>>")
        for a in by:
            chosen = F.when(F.col("l") == a, F.array(*[F.struct(F.lit(b + k * turn).alias("r"), carried(a, b).alias("a")) for b, turn in plan[a]])).otherwise(chosen)
        cells = cells_of(dealt.select("l", F.explode(chosen).alias("s"), "x", *weights).select("l", "s.r", "x", "s.a", *weights), "l", "r")
        parts.append(_per_value(cells.withColumn("r", F.col("r") % k), list(weights)))
        if routes.narrow:
            back.append(turned(cells.where(F.col("r") >= k).withColumn("r", F.col("r") % k)))
    if back:
        parts.append(_per_value(reduce(DataFrame.unionByName, back), list(weights)))
    known = [
        row for key, b in routes.known for p in [profiles[b]]
        for row in [(key, b, p.n, p.n, 0, 0.0, 0.0, 0.0, 0.0, p.n, 0), (b, key, p.n, p.distinct, p.repeated, p.pairs, 0.0, p.log, 0.0, p.distinct, p.repeated)]
    ]
    shape = "l int, r int, n bigint, kept bigint, violating bigint, lhs_pairs double, same_pairs double, x_log double, xa_log double, n_lhs bigint, repeated bigint"
    rolled = _rolled(reduce(DataFrame.unionByName, parts), list(weights)) if parts else None
    settled = df.sparkSession.createDataFrame(known, shape)
    rolled = settled if rolled is None else rolled if weights else rolled.unionByName(settled)
    names = F.array(*[F.lit(c) for c in columns])
    rolled = rolled.select(F.element_at(names, F.col("l") + 1).alias("lhs"), F.element_at(names, F.col("r") + 1).alias("rhs"), *[c for c in rolled.columns if c not in ("l", "r")])
    # the two directions of a pair sit side by side: the other row's left side is this row's right side
    w = W.partitionBy(F.least("lhs", "rhs"), F.greatest("lhs", "rhs")).orderBy("lhs")
    both = rolled.select(
        "*",
        F.coalesce(F.lag("x_log").over(w), F.lead("x_log").over(w)).alias("a_log"),
        F.coalesce(F.lag("n_lhs").over(w), F.lead("n_lhs").over(w)).alias("n_rhs"),
    )
    wanted = df.sparkSession.createDataFrame(list(pairs), "lhs string, rhs string")
    return bounded(wanted, len(pairs)).join(both, PAIR, "left").withColumn("n_total", F.lit(rows).cast("bigint"))


def pair_statistics(
    df: DataFrame,
    columns: Sequence[str],
    *,
    pairs: Sequence[tuple[str, str]] | None = None,
    exclude: Sequence[str] = (),
    weights: dict[str, Column] | None = None,
    keep: Sequence[str] = (),
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Dependency statistics of every ordered pair of ``columns`` over rows where both are present.

    The entropy of the right column is the left-side sum of the reversed pair, and
    H(right | left) = (sum n_x ln n_x - sum n_xa ln n_xa) / n. ``keep`` passes weighted sums through.
    """
    columns = [c for c in columns if c not in set(exclude)]
    require_columns(df, columns)
    chosen = list(pairs) if pairs is not None else [(a, b) for a in columns for b in columns if a != b]
    joined = _pair_table(df, columns, chosen, weights or {}, rows_per_task)
    n = F.col("n")
    h_a = F.greatest(F.ln(n) - F.col("a_log") / n, F.lit(0.0))
    h_a_x = F.greatest((F.col("x_log") - F.col("xa_log")) / n, F.lit(0.0))
    all_pairs = pair_count(n)
    stats = joined.select(
        *PAIR, "n_total",
        F.coalesce(n, F.lit(0)).alias("n_valid"),
        F.when(F.col("n_total") > 0, F.coalesce(n, F.lit(0)) / F.col("n_total")).otherwise(0.0).alias("coverage"),
        (F.col("kept") / n).alias("r_del"),
        F.when(h_a > 1e-12, 1 - h_a_x / h_a).when(n.isNotNull(), F.lit(1.0)).alias("r_ent"),
        F.when(F.col("lhs_pairs") > 0, 1 - (F.col("lhs_pairs") - F.col("same_pairs")) / F.col("lhs_pairs")).alias("r_pair"),
        F.when(all_pairs > 0, 1 - (F.col("lhs_pairs") - F.col("same_pairs")) / all_pairs).alias("r_pair_all"),
        (1 - F.col("violating") / n).alias("r_tuple"),
        (F.col("n_lhs") / n).alias("lhs_uniqueness"),
        F.when(all_pairs > 0, F.col("lhs_pairs") / all_pairs).when(n.isNotNull(), F.lit(0.0)).alias("lhs_collision"),
        (F.col("repeated") / n).alias("lhs_support_repeated"),
        h_a.alias("rhs_entropy"),
        F.coalesce("n_lhs", F.lit(0)).alias("n_lhs_values"),
        F.coalesce("n_rhs", F.lit(0)).alias("n_rhs_values"),
        F.coalesce(F.abs(F.col("kept") / n - 1) <= 1e-12, F.lit(False)).alias("exact_fd"),
        *keep,
    )
    return stats.withColumn(
        "heuristic_score",
        1.2 * F.col("r_del") + 0.8 * F.col("r_ent") + 0.5 * F.col("lhs_support_repeated")
        + 0.3 * F.col("coverage") - 0.9 * F.col("lhs_uniqueness"),
    )


def calibration_statistics(
    df: DataFrame, columns: Sequence[str], *, row_key: Sequence[str], replicates: int = 20, seed: int = 41
) -> DataFrame:
    """Dependency statistics in the calibration convention, with bootstrap stability.

    ``r_pair`` is over all pairs, ``r_ent`` is 0 for a constant right side and the right entropy is scaled
    by the log of its value count. A replicate gives each row a Poisson(1) weight drawn from its key and
    the replicate number; all replicates are sums beside the plain count, so rows are not multiplied.
    Stability is the share of replicates with r_del >= .8, repeated support >= .1 and uniqueness <= .98.
    """
    def weight(b: int) -> Column:
        return poisson_weight(F.concat_ws("~", "__id", F.lit(str(seed)), F.lit(str(b))))

    base = df.withColumn("__id", F.concat_ws("~", *[F.col(k).cast("string") for k in row_key]))
    names = [f"w{b}" for b in range(replicates)]

    def stable(w: str) -> Column:
        n = F.col(f"n_{w}")
        ok = (F.col(f"kept_{w}") >= 0.8 * n) & (F.col(f"rep_{w}") >= 0.1 * n) & (F.col(f"uni_{w}") <= 0.98 * n)
        return F.when((n > 0) & ok, 1).otherwise(0)

    share = sum((stable(w) for w in names), F.lit(0)) / F.lit(float(max(replicates, 1)))
    joined = pair_statistics(base, columns, weights={w: weight(b) for b, w in enumerate(names)}, keep=[share.alias("share")])
    few = F.col("n_valid") <= 1

    def safe(e: Column, default: float) -> Column:
        return F.when(few, F.lit(default)).otherwise(e)

    return joined.select(
        *PAIR,
        safe(F.col("r_pair_all"), 0.0).alias("r_pair"), safe(F.col("r_tuple"), 0.0).alias("r_tuple"),
        safe(F.col("r_del"), 0.0).alias("r_del"),
        safe(F.when(F.col("rhs_entropy") <= 1e-12, 0.0).otherwise(F.col("r_ent")), 0.0).alias("r_ent"),
        safe(F.col("lhs_collision"), 0.0).alias("lhs_collision_rate"),
        safe(F.col("lhs_uniqueness"), 1.0).alias("lhs_uniqueness"),
        safe(F.col("lhs_support_repeated"), 0.0).alias("lhs_support_repeated"),
        F.col("coverage"),
        safe(F.when(F.col("n_rhs_values") > 1, F.col("rhs_entropy") / F.ln(F.col("n_rhs_values"))).otherwise(0.0), 0.0).alias("rhs_entropy"),
        F.lit(1).alias("lhs_arity"),
        F.when(F.col("n_valid") >= 20, F.col("share")).otherwise(0.0).alias("bootstrap_stability"),
    )


def select_edges(
    stats: DataFrame,
    *,
    id_columns: Sequence[str] = (),
    label: str | None = None,
    categorical_rhs: Sequence[str] | None = None,
    min_r_del: float = 0.6,
    min_coverage: float = 0.5,
    min_lhs_support_repeated: float = 0.05,
    max_lhs_uniqueness: float = 0.98,
    k: int = 1,
) -> DataFrame:
    """Top ``k`` dependencies that clear the thresholds, by a logistic edge weight; never the label."""
    banned = [*id_columns, *([label] if label else [])]
    ok = (
        (F.col("r_del") >= min_r_del) & (F.col("coverage") >= min_coverage)
        & (F.col("lhs_support_repeated") >= min_lhs_support_repeated)
        & (F.col("lhs_uniqueness") < max_lhs_uniqueness) & (F.col("lhs") != F.col("rhs"))
    )
    if banned:
        ok = ok & ~F.col("lhs").isin(banned) & ~F.col("rhs").isin(banned)
    if categorical_rhs is not None:
        ok = ok & F.col("rhs").isin(list(categorical_rhs))
    raw = (
        1.5 * F.col("r_del") + F.col("r_ent") + 0.5 * F.col("lhs_support_repeated")
        + 0.3 * F.col("coverage") - F.col("lhs_uniqueness") - 1.0
    )
    return (
        stats.where(ok)
        .withColumn("edge_weight", sigmoid(raw))
        .withColumn("edge_name", F.concat_ws("->", "lhs", "rhs"))
        .withColumn("edge_type", F.lit("afd"))
        .orderBy(F.desc("edge_weight"), F.desc("r_del"), F.desc("r_ent"), "lhs", "rhs")
        .limit(k)
    )


def ambiguity_map(fit: DataFrame, lhs: str, rhs: str) -> DataFrame:
    """Per left value: majority confidence, entropy, number of right values, support."""
    cells = (
        fit.select(symbol(fit, lhs).alias("lhs_value"), symbol(fit, rhs).alias("a"))
        .dropna()
        .groupBy("lhs_value", "a")
        .agg(F.count("*").alias("n"))
    )
    total = F.sum("n")
    return cells.groupBy("lhs_value").agg(
        (F.max("n") / total).alias("majconf"),
        F.greatest(F.ln(total) - F.sum(xlogx(F.col("n"))) / total, F.lit(0.0)).alias("entropy"),
        F.count("*").alias("conflict_count"),
        total.alias("support_count"),
    )


def ambiguity_features(
    target: DataFrame,
    entity: DataFrame,
    fit: DataFrame,
    edges: Sequence[tuple[str, str]],
    *,
    row_key: Sequence[str],
    target_key: str,
    entity_key: str,
    entity_order: Sequence[str],
    entity_time: str | None = None,
    target_time: str | None = None,
    cutoff: str = "inclusive",
) -> DataFrame:
    """Four ambiguity values and four flags per edge for every target row; no edge gives bare row keys.

    With ``entity_time`` the entity has dated versions and each target row reads the latest one it may see
    at its ``target_time`` (equal times: the largest left values); otherwise the entity's first row.
    """
    if (entity_time is None) != (target_time is None):
        raise ValueError("entity_time and target_time must either both be given or neither")
    out = target.select(*row_key, F.col(target_key).alias("__key"))
    if not edges:
        return out.drop("__key")
    left = sorted({a for a, _ in edges})
    if entity_time is not None:
        version = F.struct(as_time(entity, entity_time).alias("t"), *[symbol(entity, a).alias(f"__l_{a}") for a in left])
        seen = as_of_state(
            target, entity, row_key=row_key, keys=[target_key], at=as_time(target, target_time), child_keys=[entity_key],
            child_at=effective(as_time(entity, entity_time), cutoff), maxes={"__seen": version},
        ).select(*row_key, *[F.col(f"__seen.__l_{a}").alias(f"__l_{a}") for a in left])
        seen, names = _with_maps(seen, fit, edges)
        return seen.select(*row_key, *names)
    order = [c for c in entity_order if c != entity_key]
    facts = entity.select(entity_key, *dict.fromkeys([*left, *order])).where(F.col(entity_key).isNotNull())
    one = first_row(facts, [entity_key], order or left)
    one = one.select(F.col(entity_key).alias("__key"), *[symbol(entity, c).alias(f"__l_{c}") for c in left])
    # the map meets the entity table first: one row per entity, not per target row
    one, names = _with_maps(one, fit, edges)
    return out.join(one, "__key", "left").select(*row_key, *names)


def _with_maps(rows: DataFrame, fit: DataFrame, edges: Sequence[tuple[str, str]]) -> tuple[DataFrame, list[Column]]:
    """Rows with left values ``__l_<column>`` beside each edge's ambiguity values, and the feature columns."""
    names: list[Column] = []
    for a, b in edges:
        edge = f"f_amb__{a.lower()}_to_{b.lower()}"
        parts = ["majconf", "entropy", "conflict_count", "support_count"]
        m = ambiguity_map(fit, a, b).select(F.col("lhs_value").alias(f"__l_{a}"), *[F.col(p).alias(f"{edge}__{p}") for p in parts])
        rows = rows.join(m, f"__l_{a}", "left")
        names += [F.col(f"{edge}__{p}") for p in parts]
        names += [F.col(f"{edge}__{p}").isNull().cast("int").alias(f"{edge}__{p}__is_missing") for p in parts]
    return rows, names


def majority_imputation(df: DataFrame, lhs: str, rhs: str) -> DataFrame:
    """Per left value the most frequent right value (smallest on ties) and its distinct count."""
    cells = df.select(F.col(lhs), F.col(rhs)).dropna().groupBy(lhs, rhs).agg(F.count("*").alias("n"))
    return cells.groupBy(lhs).agg(
        F.min(F.struct((-F.col("n")).alias("n"), F.col(rhs).alias("v")))["v"].alias("fd_majority"),
        F.count("*").alias("fd_conflict"),
    )


def key_profile(df: DataFrame, columns: Sequence[str], *, id_ratio: float = 0.95, exact: bool = True) -> DataFrame:
    """Per column: rows, nulls, distinct values, distinct share, and whether it looks like an id.

    Distinct counting goes through (column, value) groups, so a wide unique column spreads over all tasks.
    """
    n_all = df.agg(F.count("*").alias("n")).scalar()
    text = df.select(*[symbol(df, c).alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    if exact:
        per_value = text.groupBy("column", "value").agg(F.count("*").alias("n"))
        rolled = per_value.groupBy("column").agg(
            F.count("value").alias("n_distinct"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_null")
        )
    else:
        rolled = text.groupBy("column").agg(
            F.approx_count_distinct("value").alias("n_distinct"), F.count_if(F.col("value").isNull()).alias("n_null")
        )
    ratio = F.col("n_distinct") / F.col("n_rows")
    return rolled.withColumn("n_rows", n_all).select(
        "column", "n_rows", "n_null", "n_distinct", ratio.alias("distinct_ratio"),
        (F.col("n_null") / F.col("n_rows")).alias("null_rate"), (ratio > id_ratio).alias("id_like"),
    )


def penalised_scores(stats: DataFrame) -> DataFrame:
    """Dependency scores with and without the uniqueness penalty, in both published forms."""
    fresh = F.greatest(F.lit(0.0), 1 - F.col("lhs_uniqueness"))
    loose = 3.0 * F.col("r_del") + 0.2 * F.log1p(100.0 * F.col("lhs_support_repeated"))
    return stats.select(
        *PAIR, "lhs_uniqueness",
        F.col("r_del").alias("confidence"),
        (F.col("r_del") * fresh * fresh).alias("confidence_penalised"),
        loose.alias("score"),
        (loose - 4.0 * F.col("lhs_uniqueness")).alias("score_penalised"),
        (F.col("lhs_uniqueness") > 0.95).alias("is_id_like"),
    )


def top_edges(scores: DataFrame, variants: dict[str, str], k: int, groups: Sequence[str] = ()) -> DataFrame:
    """Top ``k`` edges per group and score variant. One row per column pair and variant: a small table."""
    long = reduce(
        lambda a, b: a.unionByName(b),
        [scores.select(*groups, *PAIR, "is_id_like", F.lit(v).alias("variant"), F.col(c).alias("value")) for v, c in variants.items()],
    )
    w = W.partitionBy(*groups, "variant").orderBy(F.desc("value"), "lhs", "rhs")
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dependency_edges(
    spark_tables: dict[str, DataFrame],
    primary_keys: dict[str, str],
    foreign_keys: Sequence[tuple[str, str, str]],
    afd: dict[str, DataFrame],
) -> DataFrame:
    """Edge table of the column graph: key -> column, references both ways, approximate dependencies."""
    spark = next(iter(spark_tables.values())).sparkSession
    declared = [
        (f"{t}.{k}", f"{t}.{c}", "schema_fd", 1.0)
        for t, k in primary_keys.items() for c in spark_tables[t].columns if c != k
    ]
    for t, c, p in foreign_keys:
        declared += [
            (f"{t}.{c}", f"{p}.{primary_keys[p]}", "fk_ind", 1.0),
            (f"{p}.{primary_keys[p]}", f"{t}.{c}", "inverse_fk", 1.0),
        ]
    out = spark.createDataFrame(declared, "src string, dst string, edge_type string, weight double")
    out = out.withColumn("r_del", F.lit(None).cast("double"))
    for t, edges in afd.items():
        out = out.unionByName(
            edges.select(
                F.concat(F.lit(f"{t}."), "lhs").alias("src"), F.concat(F.lit(f"{t}."), "rhs").alias("dst"),
                F.lit("afd").alias("edge_type"), F.col("edge_weight").alias("weight"), "r_del",
            )
        )
    return out


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-free fingerprint of the chosen columns: row count, xor and sum of 60 bits of each row's MD5.

    A row is its values as text with a unit separator between them; NULL is the symbol for the empty set.
    """
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u2205")) for c in columns])
    h = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")
    return df.agg(F.count("*").alias("row_count"), F.bit_xor(h).alias("hash_xor"), F.sum(h % F.lit(1_000_003)).alias("hash_sum"))
