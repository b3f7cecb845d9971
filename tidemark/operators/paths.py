"""Features over two linked tables: bridge lookups, pivot histories, link counts, path checks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import as_time, days_between, days_interval, number, tick
from tidemark.operators.history import ARRAY_ROWS, first_seen, reach_counts
from tidemark.operators import scan
from tidemark.operators.scan import choose_splits, measure_groups
from tidemark.operators.temporal import AT, as_of_state, centre_of, effective, spread

# Instants before and after any data, for rows whose own time is unknown.
LONG_AGO = "0001-01-02 00:00:00"
FAR_AHEAD = "9999-12-30 00:00:00"
GROUP_ROWS = 4_096  # rows of a group that every key of the group may look through
FEW_ASKED = 4  # rows of a key up to which each looks through its groups by itself


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _one() -> Column:
    return F.lit(1).cast("bigint")


def _instant(df: DataFrame, column: str | None, unknown: str) -> Column:
    if column is None:
        return F.lit(unknown).cast("timestamp_ntz")
    t = as_time(df, column)
    kind = df.select(t.alias("t")).schema["t"].dataType
    return F.coalesce(t, F.lit(unknown).cast(kind))


def link_counts(
    target: DataFrame,
    links: DataFrame,
    *,
    row_key: Sequence[str],
    keys: Sequence[str],
    target_time: str | None,
    link_keys: Sequence[str],
    link_time: str | None,
    second_key: str,
    attributes: Sequence[str] = (),
    prefix: str = "link",
    splits: int | None = None,
) -> DataFrame:
    """Distinct linked keys and fractional days since the last link, lenient about unknown times.

    Undated links always count and undated targets see every link. Days are clipped at 0 and filled
    with 0 under a missing flag. ``attributes`` adds the distinct count of further link columns.
    """
    at = _instant(target, target_time, FAR_AHEAD)
    when = _instant(links, link_time, LONG_AGO)
    if splits is None:
        splits = choose_splits((target, keys, "k"), (links, link_keys, "k"))
    parts = [
        first_seen(links, link_keys, F.col(c), when).select(*link_keys, "__t", _one().alias(f"__d_{i}"))
        for i, c in enumerate([second_key, *attributes])
    ]
    if link_time is not None:
        dated = links.where(F.col(link_time).isNotNull())
        parts.append(dated.select(*link_keys, when.alias("__t"), when.alias("__last")))
    state = as_of_state(
        target, _union(parts), row_key=row_key, keys=keys, at=at, child_keys=link_keys, child_at=F.col("__t"),
        adds={f"__d_{i}": F.col(f"__d_{i}") for i in range(1 + len(attributes))},
        maxes={"__last": F.col("__last")} if link_time is not None else {}, splits=splits,
    )
    out = [F.coalesce(F.col("__d_0"), F.lit(0).cast("bigint")).alias(f"{prefix}_count")]
    if link_time is not None and target_time is not None:
        known = F.col(AT) < F.lit(FAR_AHEAD).cast("timestamp_ntz")
        days = F.when(known, days_between(F.col("__last"), F.col(AT)))
        out += [
            F.greatest(F.coalesce(days, F.lit(0.0)), F.lit(0.0)).alias(f"{prefix}_days_since_last"),
            days.isNull().cast("int").alias(f"{prefix}_days_since_last__is_missing"),
        ]
    out += [
        F.coalesce(F.col(f"__d_{i + 1}"), F.lit(0).cast("bigint")).alias(f"{prefix}_{c.lower()}_nunique")
        for i, c in enumerate(attributes)
    ]
    return state.select(*row_key, *out)


def two_hop_features(
    target: DataFrame,
    bridge: DataFrame,
    second: DataFrame,
    *,
    row_key: Sequence[str],
    key: str,
    target_time: str | None,
    bridge_key: str,
    bridge_time: str | None,
    second_key: str,
    second_pk: str,
    numeric: Sequence[str] = (),
    categorical: Sequence[str] = (),
    prefix: str = "hop2",
    splits: int | None = None,
) -> DataFrame:
    """Target <- bridge -> second: distinct second keys, mean/std/min/max per number, distinct texts.

    Lenient cutoff on the bridge time. The bridge meets its second table once, many-to-one, and the
    joined rows are read as a running state, so the work does not depend on targets per key. Missing
    results are 0; std is the sample one and 0 below two values.
    """
    if splits is None:
        splits = choose_splits((target, [key], "k"), (bridge, [bridge_key], "k"))
    joined = bridge.select(
        F.col(bridge_key).alias("__k"), F.col(second_key).alias("__s"),
        _instant(bridge, bridge_time, LONG_AGO).alias("__t"),
    ).where(F.col("__k").isNotNull()).join(
        second.select(F.col(second_pk).alias("__s"), *numeric, *categorical), "__s", "left"
    )
    centres = {c: centre_of(second, number(c)) for c in numeric}
    moved = joined.select("__k", "__t", "__s", *[number(c).alias(c) for c in numeric], *categorical)
    for i, c in enumerate(numeric):
        moved = moved.withColumn(f"d_{i}", F.col(c) - centres[c])
    parts = [
        moved.groupBy("__k", "__t").agg(
            *[F.count(c).alias(f"n_{i}") for i, c in enumerate(numeric)],
            *[F.sum(c).alias(f"s_{i}") for i, c in enumerate(numeric)],
            *[F.sum(f"d_{i}").alias(f"e_{i}") for i in range(len(numeric))],
            *[F.sum(F.col(f"d_{i}") * F.col(f"d_{i}")).alias(f"q_{i}") for i in range(len(numeric))],
            *[F.max(c).alias(f"hi_{i}") for i, c in enumerate(numeric)],
            *[F.min(c).alias(f"lo_{i}") for i, c in enumerate(numeric)],
        )
    ] if numeric else []
    for i, c in enumerate(["__s", *categorical]):
        parts.append(first_seen(moved, ["__k"], F.col(c), F.col("__t")).select("__k", "__t", _one().alias(f"u_{i}")))
    span = range(len(numeric))
    sums = [f"{p}_{i}" for p in ("n", "s", "e", "q") for i in span] + [f"u_{i}" for i in range(1 + len(categorical))]
    state = as_of_state(
        target, _union(parts), row_key=row_key, keys=[key], at=_instant(target, target_time, FAR_AHEAD),
        child_keys=["__k"], child_at=F.col("__t"), adds={c: F.col(c) for c in sums},
        maxes={f"hi_{i}": F.col(f"hi_{i}") for i in span}, mins={f"lo_{i}": F.col(f"lo_{i}") for i in span}, splits=splits,
    )

    def filled(e: Column) -> Column:
        return F.coalesce(e, F.lit(0.0))

    out = [F.coalesce(F.col("u_0"), F.lit(0).cast("bigint")).alias(f"{prefix}_count_distinct")]
    for i, c in enumerate(numeric):
        n = F.col(f"n_{i}")
        out += [
            filled(F.when(n > 0, F.col(f"s_{i}") / n)).alias(f"{prefix}_{c.lower()}_mean"),
            filled(F.when(n > 1, spread(F.col(f"q_{i}"), F.col(f"e_{i}"), n, 1))).alias(f"{prefix}_{c.lower()}_std"),
            filled(F.col(f"lo_{i}")).alias(f"{prefix}_{c.lower()}_min"),
            filled(F.col(f"hi_{i}")).alias(f"{prefix}_{c.lower()}_max"),
        ]
    out += [
        F.coalesce(F.col(f"u_{i + 1}"), F.lit(0).cast("bigint")).alias(f"{prefix}_{c.lower()}_nunique")
        for i, c in enumerate(categorical)
    ]
    return state.select(*row_key, *out)


def _points(target: DataFrame, key: str, target_time: str) -> DataFrame:
    """Distinct (key, cutoff) pairs: targets that ask the same question share one answer."""
    return (
        target.select(F.col(key).alias("__key"), as_time(target, target_time).alias("__when"))
        .dropna()
        .distinct()
    )


def _answer(target: DataFrame, row_key: Sequence[str], key: str, target_time: str, answers: DataFrame) -> DataFrame:
    asked = target.select(*row_key, F.col(key).alias("__key"), as_time(target, target_time).alias("__when"))
    return asked.join(answers, ["__key", "__when"], "left")


def _through_links(
    points: DataFrame, links: DataFrame, events: DataFrame, adds: Sequence[str], maxes: Sequence[str], splits: int
) -> DataFrame:
    """Combined state of all groups a point's key has joined by then.

    ``points(__key, __when)`` are distinct, ``links(__key, __group, __f)`` unique, and ``events(__group,
    __at, states)`` are one row per group and instant. A link is answered either by looking the group's
    running state up at each point of the key, or, when the key has more points than the group has events, by
    handing the group's events to the key from the link time on. So the cost of every link is the smaller of
    the two counts, and neither a hot key nor a hot group multiplies out. The lookups that meet in a group and the
    events that meet at a key are counted from these sizes, and sliced where they exceed a task.
    """
    states = [*adds, *maxes]
    combine = {**{c: F.sum for c in adds}, **{c: F.max for c in maxes}}
    asked = points.groupBy("__key").agg(F.count("*").alias("__np"))
    sizes = events.groupBy("__group").agg(F.count("*").alias("__ne"))
    routed = links.join(asked, "__key").join(sizes, "__group")
    looked, handed = routed.where("__np <= __ne"), routed.where("__np > __ne")
    if splits == 1:
        met = looked.groupBy("__group").agg(F.sum("__np").alias("n")).agg(F.max("n").alias("n"))
        met = met.unionAll(handed.groupBy("__key").agg(F.sum("__ne").alias("n")).agg(F.max("n").alias("n")))
        splits = 1 if (met.agg(F.max("n")).first()[0] or 0) <= scan.ROWS_PER_TASK else scan.BY_SIZE
    handed = (
        handed.select("__key", "__group", "__f")
        .join(events, "__group")
        .groupBy("__key", F.greatest("__at", "__f").alias("__at"))
        .agg(*[combine[c](c).alias(c) for c in states])
    )
    paired = points.join(looked.select("__key", "__group", "__f"), "__key").where(F.col("__f") <= F.col("__when")).select("__key", "__when", "__group")
    how = {"adds": {c: F.col(c) for c in adds}, "maxes": {c: F.col(c) for c in maxes}, "child_at": F.col("__at"), "splits": splits}
    found = as_of_state(
        paired, events, row_key=["__key", "__when", "__group"], keys=["__group"], at=F.col("__when"), child_keys=["__group"], **how
    ).select("__key", "__when", *states)
    given = as_of_state(
        points, handed, row_key=["__key", "__when"], keys=["__key"], at=F.col("__when"), child_keys=["__key"], **how
    ).select("__key", "__when", *states)
    return found.unionByName(given).groupBy("__key", "__when").agg(*[combine[c](c).alias(c) for c in states])


def _small(top: Mapping[str, int]) -> bool:
    """Whether ``_through_arrays`` is bounded: keys asked a few times (t), small groups (s), no row that reaches many members."""
    return top["t"] <= FEW_ASKED and top["s"] <= GROUP_ROWS and top["k"] * top["s"] <= ARRAY_ROWS


def _through_arrays(
    points: DataFrame, links: DataFrame, rows: DataFrame, adds: Mapping[str, Callable[[Column], Column]],
    maxes: Mapping[str, Callable[[Column], Column]], cutoff: str, beside: Mapping[str, Column] | None = None,
) -> DataFrame:
    """(__key, __when, groups, members, states) of points whose groups are small: one shuffle by key, group and point each.

    ``links(__key, __group, __f)`` may repeat. All of a group's ``rows(__group, __t, __member, ...)`` are one array; a point
    reads it once per group it has joined, and its states and the members it sees leave together, so that neither links nor
    rows are shuffled again for each of them. ``adds`` and ``maxes`` are functions of the array of rows a point sees, which may
    use the columns ``beside``.
    """
    at = F.col("__when")
    known = links.where(F.col("__group").isNotNull())
    steps = points.join(known, "__key").where(F.col("__f") <= at).select("__key", "__when", "__group").distinct()
    fields = [c for c in rows.columns if c != "__group"]
    lists = rows.repartition("__group").groupBy("__group").agg(F.collect_list(F.struct(*fields)).alias("__list"))
    past = (lambda m: m["__t"] < at) if cutoff == "strict" else (lambda m: m["__t"] <= at)
    met = steps.join(lists, "__group", "left").withColumns({"__seen": F.filter("__list", past), **(beside or {})})
    states = {**adds, **maxes}
    met = met.select(
        "__key", "__when", *[F.when(F.col("__list").isNotNull(), f(F.col("__seen"))).alias(c) for c, f in states.items()],
        F.array_distinct(F.array_compact(F.transform("__seen", lambda m: m["__member"]))).alias("__members"),
    )
    return met.groupBy("__key", "__when").agg(
        F.count("*").alias("groups"), *[F.sum(c).alias(c) for c in adds], *[F.max(c).alias(c) for c in maxes],
        F.size(F.array_distinct(F.flatten(F.collect_list("__members")))).cast("bigint").alias("members"),
    )


def pivot_history(
    target: DataFrame,
    base: DataFrame,
    second: DataFrame,
    *,
    row_key: Sequence[str],
    key: str,
    target_time: str,
    base_key: str,
    base_time: str,
    pivot: str,
    second_key: str,
    second_time: str,
    value: str,
    prefix: str = "pivot",
    cutoff: str = "strict",
    hot_pairs: int = 250_000,
    splits: int | None = None,
) -> DataFrame:
    """Target -> pivots of its visible base rows -> all visible rows of those pivots.

    Every (key, cutoff, pivot) reads the pivot's running state instead of its rows, so a popular pivot is
    scanned once. Distinct values go through first-reach times. Where keys are asked a few times and pivots are small, every
    (key, cutoff, pivot) reads the pivot's rows as one array instead. No limit on pivots per row. Outputs
    pivot_nunique, count, mean, sample std (0 below two values), max, nunique, days since last.
    """
    bounds, small = {}, False
    if splits is None:
        asked = target.where(F.col(key).isNotNull())
        splits, top = measure_groups(
            (asked, [key], "k"), (asked, [key], "t"), (base, [base_key], "k"), (base, [pivot], "b"), (second, [second_key], "s")
        )
        small = _small(top)
        bounds = {"most_pairs": top["b"] * top["s"], "most_asked": top["t"], "most_reached": top["k"] * top["s"]}
    points = _points(target, key, target_time)
    joined = effective(as_time(base, base_time), cutoff)
    v = number(value)
    rows = second.where(F.col(second_time).isNotNull()).select(
        F.col(second_key).alias("__group"), as_time(second, second_time).alias("__t"), v.alias("__v")
    ).where(F.col("__group").isNotNull())
    if small:
        answers = _pivots_by_arrays(points, base.select(F.col(base_key).alias("__key"), F.col(pivot).alias("__group"), joined.alias("__f")), rows, centre_of(second, v), cutoff)
    else:
        links = first_seen(base.withColumnRenamed(base_key, "__key"), ["__key"], F.col(pivot), joined).select(
            "__key", F.col("__item").alias("__group"), F.col("__t").alias("__f")
        )
        rows = rows.withColumn("__d", F.col("__v") - centre_of(second, v))
        events = rows.groupBy("__group", effective(F.col("__t"), cutoff).alias("__at")).agg(
            F.count("__v").alias("n"), F.sum("__v").alias("s"), F.sum("__d").alias("d"),
            F.sum(F.col("__d") * F.col("__d")).alias("q"), F.max("__v").alias("mx"), F.max("__t").alias("last"),
        )
        per_point = _through_links(points, links, events, ["n", "s", "d", "q"], ["mx", "last"], splits)
        pivots = as_of_state(
            points, links, row_key=["__key", "__when"], keys=["__key"], at=F.col("__when"), child_keys=["__key"],
            child_at=F.col("__f"), adds={"pivots": _one()}, splits=splits,
        ).select("__key", "__when", "pivots")
        valued = rows.where(F.col("__v").isNotNull()).select(
            "__group", F.col("__v").alias("__member"), effective(F.col("__t"), cutoff).alias("__g")
        )
        distinct = reach_counts(
            points, links, valued, row_key=["__key", "__when"], key="__key",
            at=F.col("__when"), name="values", hot_pairs=hot_pairs, splits=splits, **bounds,
        )
        answers = pivots.join(per_point, ["__key", "__when"], "left").join(distinct, ["__key", "__when"])
    out = _answer(target, row_key, key, target_time, answers)
    n = F.coalesce(F.col("n"), F.lit(0).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    seen = F.col("last").isNotNull()
    return out.select(
        *row_key,
        F.coalesce(F.col("pivots"), zero).alias(f"{prefix}_pivot_nunique"),
        n.alias(f"{prefix}_count"),
        F.when(n > 0, F.col("s") / n).alias(f"{prefix}_mean"),
        F.when(n > 1, spread(F.col("q"), F.col("d"), n, 1)).when(seen, F.lit(0.0)).alias(f"{prefix}_std"),
        F.col("mx").alias(f"{prefix}_max"),
        F.coalesce(F.col("values"), zero).alias(f"{prefix}_nunique"),
        days_between(F.col("last"), F.col("__when")).alias(f"{prefix}_days_since_last"),
    )


def _pivots_by_arrays(points: DataFrame, links: DataFrame, rows: DataFrame, centre: Column, cutoff: str) -> DataFrame:
    """The answers of ``pivot_history`` from one array of (time, value) per pivot."""
    moved = lambda m: m["__member"] - F.col("__centre")

    def total(term: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda seen: F.aggregate(seen, F.lit(0.0), lambda a, m: a + F.coalesce(term(m), F.lit(0.0)))

    found = _through_arrays(
        points, links, rows.select("__group", "__t", (F.col("__v") + 0.0).alias("__member")),  # one zero
        {
            "n": lambda seen: F.size(F.filter(seen, lambda m: m["__member"].isNotNull())).cast("bigint"),
            "s": total(lambda m: m["__member"]), "d": total(moved), "q": total(lambda m: moved(m) * moved(m)),
        },
        {
            "mx": lambda seen: F.array_max(F.transform(seen, lambda m: m["__member"])),
            "last": lambda seen: F.array_max(F.transform(seen, lambda m: m["__t"])),
        },
        cutoff, {"__centre": centre},
    )
    return found.withColumnsRenamed({"groups": "pivots", "members": "values"})


def incoming_link_counts(
    target: DataFrame,
    own: DataFrame,
    incoming: DataFrame,
    *,
    row_key: Sequence[str],
    key: str,
    target_time: str,
    own_key: str,
    own_item: str,
    own_time: str,
    incoming_item: str,
    incoming_source: str,
    incoming_time: str,
    window_days: int = 365,
    prefix: str = "incoming",
    cutoff: str = "strict",
    lower: str = "inclusive",
    hot_pairs: int = 250_000,
    splits: int | None = None,
) -> DataFrame:
    """References to the items a key owned by the cutoff: count, distinct sources, recent count.

    A reference enters the recent count when it becomes visible and leaves once the window has passed it.
    """
    bounds, small = {}, False
    if splits is None:
        asked = target.where(F.col(key).isNotNull())
        splits, top = measure_groups(
            (asked, [key], "k"), (asked, [key], "t"), (own, [own_key], "k"), (own, [own_item], "b"), (incoming, [incoming_item], "s")
        )
        small = _small(top)
        bounds = {"most_pairs": top["b"] * top["s"], "most_asked": top["t"], "most_reached": top["k"] * top["s"]}
    points = _points(target, key, target_time)
    joined = effective(as_time(own, own_time), cutoff)
    time = as_time(incoming, incoming_time)
    refs = incoming.select(
        F.col(incoming_item).alias("__group"), F.col(incoming_source).alias("__member"), time.alias("__t"),
    ).where(F.col("__group").isNotNull() & F.col("__t").isNotNull())
    if small:
        left = F.col("__when") - days_interval(window_days)
        left = left - tick() if lower == "inclusive" else left
        answers = _through_arrays(
            points, own.select(F.col(own_key).alias("__key"), F.col(own_item).alias("__group"), joined.alias("__f")), refs,
            {
                "n": lambda seen: F.size(seen).cast("bigint"),
                "recent": lambda seen: (F.size(seen) - F.size(F.filter("__list", lambda m: m["__t"] <= left))).cast("bigint"),
            },
            {}, cutoff,
        ).withColumnRenamed("members", "sources")
    else:
        links = first_seen(own.withColumnRenamed(own_key, "__key"), ["__key"], F.col(own_item), joined).select(
            "__key", F.col("__item").alias("__group"), F.col("__t").alias("__f")
        )
        refs = refs.withColumn("__g", effective(F.col("__t"), cutoff))
        leave = F.col("__t") + days_interval(window_days)
        leave = leave + tick() if lower == "inclusive" else leave
        steps = F.explode(
            F.array(
                F.struct(F.col("__g").alias("at"), _one().alias("n"), _one().alias("r")),
                F.struct(leave.alias("at"), F.lit(0).cast("bigint").alias("n"), (-_one()).alias("r")),
            )
        )
        events = refs.select("__group", steps.alias("e")).groupBy("__group", F.col("e.at").alias("__at")).agg(
            F.sum("e.n").alias("n"), F.sum("e.r").alias("recent")
        )
        per_point = _through_links(points, links, events, ["n", "recent"], [], splits)
        sources = reach_counts(
            points, links, refs.where(F.col("__member").isNotNull()).select("__group", "__member", "__g"),
            row_key=["__key", "__when"], key="__key", at=F.col("__when"), name="sources", hot_pairs=hot_pairs, splits=splits, **bounds,
        )
        answers = sources.join(per_point, ["__key", "__when"], "left")
    out = _answer(target, row_key, key, target_time, answers)
    zero = F.lit(0).cast("bigint")
    return out.select(
        *row_key,
        F.coalesce("n", zero).alias(f"{prefix}_count"),
        F.coalesce("sources", zero).alias(f"{prefix}_sources"),
        F.coalesce("recent", zero).alias(f"{prefix}_count_{window_days}d"),
    )


def join_containment(
    child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, path: str
) -> DataFrame:
    """Evidence that ``child.child_key`` refers to ``parent.parent_key``.

    One row: distinct child values, how many are absent from the parent, whether the parent column is
    unique, and ``valid`` (all present and unique).
    """
    used = child.select(F.col(child_key).alias("v")).where(F.col("v").isNotNull()).distinct()
    owned = parent.select(F.col(parent_key).alias("v")).where(F.col("v").isNotNull()).groupBy("v").agg(F.count("*").alias("n"))
    both = used.withColumn("u", F.lit(1)).join(owned, "v", "full_outer")
    out = both.agg(
        F.count("u").alias("child_values"),
        F.count_if(F.col("u").isNotNull() & F.col("n").isNull()).alias("orphans"),
        F.coalesce(F.max("n"), F.lit(0)).alias("most"),
    )
    return out.select(
        F.lit(path).alias("path"), "child_values", "orphans",
        (F.col("most") == 1).alias("parent_unique"),
        ((F.col("most") == 1) & (F.col("orphans") == 0) & (F.col("child_values") > 0)).alias("valid"),
    )


def discover_two_hops(
    tables: dict[str, DataFrame],
    primary_keys: dict[str, str],
    *,
    target_table: str,
    foreign_keys: Sequence[tuple[str, str, str]],
    skip_columns: Sequence[str] = (),
) -> DataFrame:
    """Checked two-hop paths target <- bridge -> second.

    ``foreign_keys`` lists candidate (table, column, parent table) references. A path is kept with its
    containment evidence; usable columns of the second table leave out keys, times and ``skip_columns``.
    """
    skipped = {c.lower() for c in skip_columns}
    references = {(t, c, p) for t, c, p in foreign_keys if t in tables and p in tables}
    rows: list[DataFrame] = []
    for bridge, first, parent in sorted(references):
        if parent != target_table:
            continue
        for other, second_key, second in sorted(references):
            if other != bridge or second_key == first or second == target_table:
                continue
            id_like = {primary_keys[second], *[c for t, c, _ in references if t == second]}
            usable = [
                f.name for f in tables[second].schema.fields
                if f.name not in id_like and f.name.lower() not in skipped
                and f.dataType.typeName() not in ("timestamp", "timestamp_ntz", "date")
            ]
            if not usable:
                continue
            path = f"{target_table}<-{bridge}.{first}|{bridge}.{second_key}->{second}"
            checked = join_containment(tables[bridge], second_key, tables[second], primary_keys[second], path)
            rows.append(checked.withColumn("usable_columns", F.lit(",".join(usable))))
    if not rows:
        raise ValueError("no two-hop path among the given references")
    return _union(rows)
