"""Point-in-time features: state of a child table as of each target row's own cutoff.

No target row is ever paired with its child rows. Child rows and target probes of a key are merged
into one time-ordered stream and each probe reads a running state; look-back windows are differences
of two probes. Work is O(rows log rows) per key whatever the number of targets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.columns import as_time, days_between, days_interval, number, require_columns, tick
from tidemark.operators.scan import BY_SIZE, choose_splits, prefix_scan

AT = "__at"
PROBE = "__probe"
ASIDE = "__aside"


def effective(time: Column, cutoff: str) -> Column:
    """When a child row becomes visible: its own instant, or one tick later under a strict cutoff."""
    if cutoff == "strict":
        return time + tick()
    if cutoff == "inclusive":
        return time
    raise ValueError(f"cutoff must be 'inclusive' or 'strict', not {cutoff!r}")


def window_start(time: Column, days: int, cutoff: str, lower: str = "exclusive") -> Column:
    """Probe instant to subtract so that only children inside the look-back remain."""
    start = effective(time - days_interval(days), cutoff)
    if lower == "exclusive":
        return start
    if lower == "inclusive":
        return start - tick()
    raise ValueError(f"lower must be 'exclusive' or 'inclusive', not {lower!r}")


def as_of_state(
    target: DataFrame,
    child: DataFrame,
    *,
    row_key: Sequence[str],
    keys: Sequence[str],
    at: Column,
    child_keys: Sequence[str],
    child_at: Column,
    adds: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    mins: Mapping[str, Column] | None = None,
    probes: Mapping[str, Column] | None = None,
    splits: int | None = None,
) -> DataFrame:
    """State of all child rows with ``child_at <= probe`` for every target row.

    ``adds``/``maxes``/``mins`` are per-child-row expressions combined by sum, maximum or minimum.
    ``probes`` names further instants per target row; their states come back as ``<probe>__<state>``
    next to the plain ``<state>`` of ``at``. Rows with an unknown key or time get NULL states, and so
    do rows with no visible child. Output: row_key, the cutoff ``__at`` and the states, one row per
    target row.

    ``splits=None`` counts rows per key of both inputs first: with no oversized key the whole operator is one
    exchange on the key; otherwise the time axis is sliced and probes are answered once per distinct
    (key, instant).
    """
    row_key, keys = list(row_key), list(keys)
    adds, maxes, mins = dict(adds or {}), dict(maxes or {}), dict(mins or {})
    probes = dict(probes or {})
    states = [*adds, *maxes, *mins]
    exprs = {**adds, **maxes, **mins}
    if set(states) & set(row_key):
        raise ValueError(f"row key columns {sorted(set(states) & set(row_key))} clash with state names")
    pick = {**{c: F.sum for c in adds}, **{c: F.max for c in maxes}, **{c: F.min for c in mins}}
    hidden = [f"__k{i}" for i in range(len(keys))]
    rows = [f"__r{i}" for i in range(len(row_key))]

    events = (
        child.select(
            *[F.col(c).alias(h) for c, h in zip(child_keys, hidden, strict=True)],
            child_at.alias(AT),
            *[e.alias(c) for c, e in exprs.items()],
        )
        .where(F.col(AT).isNotNull())
        .dropna(subset=hidden)
    )
    asked = target.select(
        *[F.col(c).alias(r) for c, r in zip(row_key, rows, strict=True)],
        *[F.col(c).alias(h) for c, h in zip(keys, hidden, strict=True)],
        at.alias(AT),
        *[p.alias(f"__p_{n}") for n, p in probes.items()],
    )
    unknown = F.col(AT).isNull()
    for h in hidden:
        unknown = unknown | F.col(h).isNull()
    if splits is None:
        splits = choose_splits((child, child_keys, "k"), (target, keys, "k"), copies=1 + len(probes))
    # in one exchange, rows without a key or time ride along in groups of their own, spread by their row key
    own = F.when(unknown, F.pmod(F.xxhash64(*rows), F.lit(1021)) + 1).otherwise(F.lit(0).cast("bigint"))
    known = asked.withColumn(ASIDE, own) if splits == 1 else asked.where(~unknown).withColumn(ASIDE, F.lit(0))
    if probes:
        shots = F.array(
            F.struct(F.lit("").alias("n"), F.col(AT).alias("t")),
            *[F.struct(F.lit(n).alias("n"), F.col(f"__p_{n}").alias("t")) for n in probes],
        )
        known = known.select(*rows, *hidden, ASIDE, F.explode(shots).alias("s")).select(
            *rows, *hidden, ASIDE, F.col("s.n").alias(PROBE), F.col("s.t").alias(AT)
        )
    else:
        known = known.select(*rows, *hidden, ASIDE, F.lit("").alias(PROBE), AT)

    if splits == 1:
        marked = events.withColumns({ASIDE: F.lit(0).cast("bigint"), "__side": F.lit(0)}).unionByName(
            known.withColumn("__side", F.lit(1)), allowMissingColumns=True
        )
        w = W.partitionBy(*hidden, ASIDE).orderBy(AT, "__side").rowsBetween(W.unboundedPreceding, 0)
        answered = marked.select(
            *rows, *hidden, ASIDE, PROBE, AT, "__side", *[pick[c](c).over(w).alias(c) for c in states]
        ).where(F.col("__side") == 1)
    else:
        instants = known.select(*hidden, AT).distinct().unionByName(
            events.groupBy(*hidden, AT).agg(*[pick[c](c).alias(c) for c in states]), allowMissingColumns=True
        )
        merged = instants.groupBy(*hidden, AT).agg(*[pick[c](c).alias(c) for c in states])
        running = prefix_scan(
            merged, hidden, AT, adds=list(adds), maxes=list(maxes), mins=list(mins), splits=splits,
            marks_from=None if splits == BY_SIZE else events.select(*hidden, AT),  # by size: probes count as well
        )
        answered = known.join(running, [*hidden, AT], "left")

    if probes:
        def of(probe: str, state: str) -> Column:
            return F.max(F.when(F.col(PROBE) == probe, F.col(state)))

        answered = answered.groupBy(*hidden, ASIDE, *rows).agg(
            F.max(F.when(F.col(PROBE) == "", F.col(AT))).alias(AT),
            *[of("", c).alias(c) for c in states],
            *[of(n, c).alias(f"{n}__{c}") for n in probes for c in states],
        )
    names = [*states, *[f"{n}__{c}" for n in probes for c in states]]
    out = answered.select(*rows, AT, *names)
    if splits != 1:
        out = out.unionByName(asked.where(unknown).select(*rows, AT), allowMissingColumns=True)
    return out.select(*[F.col(r).alias(c) for r, c in zip(rows, row_key, strict=True)], AT, *names)


def centre_of(df: DataFrame, value: Column) -> Column:
    """Mean of a column as a scalar subquery; moments taken around it do not cancel."""
    return F.coalesce(df.agg(F.avg(value)).scalar(), F.lit(0.0))


def spread(q: Column, d: Column, n: Column, ddof: int) -> Column:
    """Standard deviation from centred moments; NULL where undefined."""
    ss = F.greatest(q - d * d / n, F.lit(0.0))
    return F.when(n > ddof, F.sqrt(ss / (n - ddof)))


def point_in_time_features(
    target: DataFrame,
    child: DataFrame,
    *,
    row_key: Sequence[str],
    keys: Sequence[str],
    target_time: str,
    child_keys: Sequence[str],
    child_time: str,
    value: str,
    prefix: str,
    cutoff: str = "inclusive",
    splits: int | None = None,
) -> DataFrame:
    """Count, mean, population std, max and whole days since last of all visible child rows.

    Child rows with a NULL value are ignored. An empty history has count 0 and NULL elsewhere; each
    output also has a ``__is_missing`` flag.
    """
    require_columns(target, [*row_key, *keys, target_time], "target")
    require_columns(child, [*child_keys, child_time, value], "child")
    usable = child.where(F.col(value).isNotNull())
    when = as_time(child, child_time)
    v = number(value)
    usable = usable.withColumn("__d", v - centre_of(usable, v))
    state = as_of_state(
        target, usable, row_key=row_key, keys=keys, at=as_time(target, target_time), child_keys=child_keys,
        child_at=effective(when, cutoff),
        adds={"n": F.lit(1).cast("bigint"), "s": v, "d": F.col("__d"), "q": F.col("__d") * F.col("__d")},
        maxes={"mx": v, "last": when}, splits=splits,
    )
    n = F.col("n")
    named = {
        "count": F.coalesce(n, F.lit(0).cast("bigint")),
        "mean": F.col("s") / n,
        "std": spread(F.col("q"), F.col("d"), n, 0),
        "max": F.col("mx"),
        "days_since_last": F.datediff(F.col(AT), F.col("last")).cast("bigint"),
    }
    out = state.select(*row_key, *[e.alias(f"{prefix}_{k}") for k, e in named.items()])
    flags = [F.col(f"{prefix}_{k}").isNull().cast("int").alias(f"{prefix}_{k}__is_missing") for k in named]
    return out.select("*", *flags)


def latest_value(
    target: DataFrame,
    child: DataFrame,
    *,
    row_key: Sequence[str],
    keys: Sequence[str],
    target_time: str,
    child_keys: Sequence[str],
    child_time: str,
    value: str,
    prefix: str,
    cutoff: str = "inclusive",
    splits: int | None = None,
) -> DataFrame:
    """Value at the latest visible child instant (averaged over rows of that instant) and its age in days."""
    v = number(value)
    when = as_time(child, child_time)
    per_instant = (
        child.where(F.col(value).isNotNull())
        .groupBy(*child_keys, when.alias("__t"))
        .agg(F.avg(v).alias("__v"))
    )
    state = as_of_state(
        target, per_instant, row_key=row_key, keys=keys, at=as_time(target, target_time), child_keys=child_keys,
        child_at=effective(F.col("__t"), cutoff), maxes={"s": F.struct("__t", "__v")}, splits=splits,
    )
    return state.select(
        *row_key,
        F.col("s.__v").alias(f"{prefix}_latest"),
        F.datediff(F.col(AT), F.col("s.__t")).cast("bigint").alias(f"{prefix}_days_since_latest"),
    )


def lookback_features(
    target: DataFrame,
    child: DataFrame,
    *,
    row_key: Sequence[str],
    keys: Sequence[str],
    target_time: str,
    child_keys: Sequence[str],
    child_time: str,
    value: str,
    prefix: str,
    windows_days: Sequence[int] = (30, 90),
    cutoff: str = "inclusive",
    lower: str = "exclusive",
    tiebreak: Sequence[str] = (),
    splits: int | None = None,
) -> DataFrame:
    """All-past count/mean/sample std, last value and its age, per-window count and mean, and trends.

    Counts count non-null values. ``trend_last_minus_mean`` compares the last value with the all-past
    mean; each window also yields ``trend_recent<w>_minus_all``. ``tiebreak`` orders rows of one instant.
    """
    v = number(value)
    when = as_time(child, child_time)
    rows = child.withColumn("__v", v)
    rows = rows.withColumn("__d", F.col("__v") - centre_of(child, v))
    at = as_time(target, target_time)
    state = as_of_state(
        target, rows, row_key=row_key, keys=keys, at=at, child_keys=child_keys, child_at=effective(when, cutoff),
        adds={"n": F.col("__v").isNotNull().cast("bigint"), "d": F.col("__d"), "q": F.col("__d") * F.col("__d"), "s": F.col("__v")},
        maxes={"last": F.struct(when.alias("t"), F.struct(*tiebreak, F.col("__v").alias("__last")).alias("x"))},
        probes={f"w{w}": window_start(at, w, cutoff, lower) for w in windows_days}, splits=splits,
    )

    def upto(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    n = upto("n").cast("bigint")
    centre = F.when(n > 0, (F.col("s") - F.col("d")) / n)
    last = F.col("last.x.__last")
    mean = F.when(n > 0, F.col("s") / n)
    out = {
        "all_past_count": n,
        "all_past_mean": mean,
        "all_past_std": F.when(n > 1, spread(F.col("q"), F.col("d"), n, 1)),
        "last_value": last,
        "time_since_last_days": days_between(F.col("last.t"), F.col(AT)),
    }
    for w in windows_days:
        wn = n - upto(f"w{w}__n").cast("bigint")
        wmean = F.when(wn > 0, (upto("d") - upto(f"w{w}__d")) / wn + centre)
        out[f"recent_{w}d_count"] = wn
        out[f"recent_{w}d_mean"] = wmean
        out[f"trend_recent{w}_minus_all"] = wmean - mean
    out["trend_last_minus_mean"] = last - mean
    return state.select(*row_key, *[e.alias(f"{prefix}_{k}") for k, e in out.items()])


def lookback_counts(
    target: DataFrame,
    child: DataFrame,
    *,
    row_key: Sequence[str],
    keys: Sequence[str],
    target_time: str,
    child_keys: Sequence[str],
    child_time: str,
    prefix: str,
    windows_days: Sequence[int] = (30, 90, 365),
    cutoff: str = "strict",
    lower: str = "exclusive",
    splits: int | None = None,
) -> DataFrame:
    """Past row count, count per look-back window and whole days since the last row."""
    when = as_time(child, child_time)
    at = as_time(target, target_time)
    state = as_of_state(
        target, child, row_key=row_key, keys=keys, at=at, child_keys=child_keys, child_at=effective(when, cutoff),
        adds={"n": F.lit(1).cast("bigint")}, maxes={"last": when},
        probes={f"w{w}": window_start(at, w, cutoff, lower) for w in windows_days}, splits=splits,
    )
    n = F.coalesce(F.col("n"), F.lit(0).cast("bigint"))
    return state.select(
        *row_key,
        n.alias(f"{prefix}_past_count"),
        *[(n - F.coalesce(F.col(f"w{w}__n"), F.lit(0).cast("bigint"))).alias(f"{prefix}_count_{w}d") for w in windows_days],
        F.datediff(F.col(AT), F.col("last")).cast("bigint").alias(f"{prefix}_days_since_last"),
    )
