"""Histories of distinct things: items, categories, partners, reached values.

Distinct counts over time become running sums of +1/-1 events, so they use the same one-pass as-of
state as plain counts and never enumerate (target row, history row) pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import as_time, days_interval, tick, xlogx
from tidemark.operators.scan import choose_splits, measure_groups, prefix_scan, with_neighbours
from tidemark.operators.temporal import AT, as_of_state, effective, window_start

ARRAY_ROWS = 262_144  # members held in one array


def _one(sign: int = 1) -> Column:
    return F.lit(sign).cast("bigint")


def first_seen(child: DataFrame, keys: Sequence[str], item: Column, time: Column) -> DataFrame:
    """(keys, __item, __t): first instant of every distinct item of a key."""
    return (
        child.select(*keys, item.alias("__item"), time.alias("__t"))
        .where(F.col("__item").isNotNull() & F.col("__t").isNotNull())
        .groupBy(*keys, "__item")
        .agg(F.min("__t").alias("__t"))
    )


def distinct_history(
    target: DataFrame,
    child: DataFrame,
    *,
    row_key: Sequence[str],
    keys: Sequence[str],
    target_time: str,
    child_keys: Sequence[str],
    child_time: str,
    items: dict[str, str],
    window_item: str | None = None,
    windows_days: Sequence[int] = (30, 90, 365),
    cutoff: str = "strict",
    lower: str = "inclusive",
    splits: int | None = None,
) -> DataFrame:
    """Distinct counts of several columns over the visible past, one of them also per look-back window.

    ``items`` maps output prefix to child column; ``window_item`` is the prefix that gets windows.
    Items inside a window = stays begun by the cutoff minus stays over by then, and a stay is over once its
    last occurrence is older than the window: one flag pair per occurrence and one extra probe per window.
    """
    when = as_time(child, child_time)
    at = as_time(target, target_time)
    clean = child.dropna(subset=list(child_keys)).withColumn("__when", when).where(F.col("__when").isNotNull())
    if splits is None:
        splits = choose_splits((child, child_keys, "k"), (target, keys, "k"))
    parts: list[DataFrame] = []

    enter = effective(F.col("__t"), cutoff)
    main = clean.select(
        *child_keys, (F.col(items[window_item]) if window_item is not None else F.lit(None).cast("string")).alias("__item"),
        F.col("__when").alias("__t"),
    )
    probes = {}
    if window_item is None:
        parts.append(main.select(*child_keys, enter.alias("__e"), F.col("__t").alias("__last")))
    else:
        # a stay is a run of occurrences each visible before the window has left the one before
        def apart(first: Column, then: Column, w: int) -> Column:
            leaves = first + days_interval(w)
            leaves = leaves + tick() if lower == "inclusive" else leaves
            return F.coalesce(leaves <= effective(then, cutoff), F.lit(True)) & F.col("__item").isNotNull()

        near = with_neighbours(main, [*child_keys, "__item"], "__t", splits)
        t, prev, following = F.col("__t"), F.col("__prev"), F.col("__next")
        parts.append(
            near.select(
                *child_keys, enter.alias("__e"), t.alias("__last"),
                (prev.isNull() & F.col("__item").isNotNull()).cast("bigint").alias(f"{window_item}_distinct"),
                *[apart(prev, t, w).cast("bigint").alias(f"__begun_{w}") for w in windows_days],
                *[apart(t, following, w).cast("bigint").alias(f"__over_{w}") for w in windows_days],
            )
        )
        probes = {f"w{w}": window_start(at, w, cutoff, lower) for w in windows_days}
    others = {n: c for n, c in items.items() if n != window_item}
    if others:
        long = clean.select(
            *child_keys, F.col("__when").alias("__t"),
            F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(c).cast("string").alias("v")) for n, c in others.items()])).alias("s"),
        ).where(F.col("s.v").isNotNull())
        first = long.groupBy(*child_keys, "s.n", "s.v").agg(F.min("__t").alias("__t"))
        parts.append(
            first.select(
                *child_keys, effective(F.col("__t"), cutoff).alias("__e"),
                *[F.when(F.col("n") == n, _one()).alias(f"{n}_distinct") for n in others],
            )
        )
    counted = [f"{name}_distinct" for name in items]
    stays = [f"__{part}_{w}" for part in ("begun", "over") for w in windows_days] if window_item is not None else []
    events = parts[0]
    for p in parts[1:]:
        events = events.unionByName(p, allowMissingColumns=True)
    state = as_of_state(
        target, events, row_key=row_key, keys=keys, at=at, child_keys=child_keys, child_at=F.col("__e"),
        adds={c: F.col(c) for c in [*counted, *stays]}, maxes={"__last": F.col("__last")}, probes=probes, splits=splits,
    )
    zero = _one(0)
    inside = {
        w: F.coalesce(F.col(f"__begun_{w}"), zero) - F.coalesce(F.col(f"w{w}____over_{w}"), zero)
        for w in (windows_days if window_item is not None else ())
    }
    return state.select(
        *row_key,
        *[F.coalesce(F.col(c), zero).alias(c) for c in counted],
        *[e.alias(f"{window_item}_distinct_{w}d") for w, e in inside.items()],
        F.datediff(F.col(AT), F.col("__last")).cast("bigint").alias("days_since_last"),
    )


def category_state(
    target: DataFrame,
    child: DataFrame,
    *,
    row_key: Sequence[str],
    keys: Sequence[str],
    target_time: str,
    child_keys: Sequence[str],
    child_time: str,
    category: str,
    item: str | None = None,
    tiebreak: Sequence[str] = (),
    prefix: str = "category",
    cutoff: str = "strict",
    splits: int | None = None,
) -> DataFrame:
    """Majority share, entropy and latest category of the visible history.

    With n_c rows of category c, entropy = ln N - (sum n_c ln n_c)/N. Counts only grow, so the largest
    n_c is a running maximum of occurrence numbers and sum n_c ln n_c a running sum of their steps.
    ``item`` counts distinct items per category instead of rows.
    """
    when = as_time(child, child_time)
    rows = (
        child.withColumn("__c", F.col(category))
        .withColumn("__t", when)
        .where(F.col("__c").isNotNull() & F.col("__t").isNotNull())
        .dropna(subset=list(child_keys))
    )
    groups = [*child_keys, "__c"]
    if item is None:
        units = rows
    else:
        units = rows.where(F.col(item).isNotNull()).groupBy(*groups, item).agg(F.min("__t").alias("__t"))
    steps = units.groupBy(*groups, "__t").agg(F.count("*").alias("__k")).withColumn("__m", F.col("__k"))
    if splits is None:
        splits = choose_splits((child, child_keys, "k"), (target, keys, "k"))
    steps = prefix_scan(steps, groups, "__t", adds=["__m"], splits=splits)
    gained = xlogx(F.col("__m")) - xlogx(F.col("__m") - F.col("__k"))
    events = steps.select(*child_keys, "__t", F.col("__k").alias("__n"), F.col("__m").alias("__top"), gained.alias("__g")).unionByName(
        rows.select(*child_keys, "__t", F.struct(F.col("__t").alias("t"), *tiebreak, F.col("__c").alias("__cat")).alias("__l")),
        allowMissingColumns=True,
    )
    state = as_of_state(
        target, events, row_key=row_key, keys=keys, at=as_time(target, target_time), child_keys=child_keys,
        child_at=effective(F.col("__t"), cutoff), adds={"__n": F.col("__n"), "__g": F.col("__g")},
        maxes={"__top": F.col("__top"), "__l": F.col("__l")}, splits=splits,
    )
    total = F.col("__n")
    return state.select(
        *row_key,
        F.coalesce(F.col("__top") / total, F.lit(0.0)).alias(f"{prefix}_majority_confidence"),
        F.coalesce(F.greatest(F.ln(total) - F.col("__g") / total, F.lit(0.0)), F.lit(0.0)).alias(f"{prefix}_entropy"),
        F.col("__l.__cat").alias(f"{prefix}_latest"),
    )


def reach_counts(
    target: DataFrame,
    links: DataFrame,
    members: DataFrame,
    *,
    row_key: Sequence[str],
    key: str,
    at: Column,
    name: str,
    splits: int,
    hot_pairs: int = 250_000,
    sizes: DataFrame | None = None,
    few_rows: int = 4,
    most_pairs: int | None = None,
    most_asked: int | None = None,
    most_reached: int | None = None,
) -> DataFrame:
    """Distinct members reached through shared groups by each target row's instant.

    ``links(__key, __group, __f)`` says key joins group at f; ``members(__group, __member, __g)`` says
    member is in group from g. A member is reached once both have happened in one group.

    Keys asked more than ``few_rows`` times: small groups yield (key, member) first times, combined map-side, and
    a key's rows share one ordered pass. A group with more than ``hot_pairs`` combinations is never paired: a target
    row reads the size of the union of its own hot groups (counted once per distinct set of hot groups, by
    instant), and members it also reaches through small groups are subtracted from the moment both ways exist.

    Keys asked less often: a group's members travel to its rows as one array, cut at the row's instant, so no
    (row, member) pair is shuffled or hashed. A set of hot groups is counted as a union only if more than
    ``few_rows`` rows share it. Exact for any mix. ``sizes(__group, __pairs)`` may be passed when links and
    members are already unique.

    ``most_pairs``, ``most_asked`` and ``most_reached`` are known upper bounds of combinations per group, rows per key
    and members per row, repeats included; without them they are measured.
    """
    if sizes is None:
        links = links.groupBy("__key", "__group").agg(F.min("__f").alias("__f"))
        members = members.groupBy("__group", "__member").agg(F.min("__g").alias("__g"))
        sizes = links.groupBy("__group").agg(F.count("*").alias("__a")).join(
            members.groupBy("__group").agg(F.count("*").alias("__b")), "__group"
        ).select("__group", (F.col("__a") * F.col("__b")).alias("__pairs"))
    sizes = sizes.where(F.col("__pairs") > hot_pairs).select("__group")
    has_hot = (most_pairs is None or most_pairs > hot_pairs) and len(sizes.limit(1).collect()) > 0
    asked = target.select(*row_key, F.col(key).alias("__rk"), at.alias("__ask"))
    if most_asked is None:
        most_asked = asked.groupBy("__rk").count().agg(F.max("count")).first()[0] or 0
    if most_asked <= few_rows:
        return _reached_by_few(
            asked, links, members, row_key=list(row_key), name=name, hot=sizes if has_hot else None, few_rows=few_rows,
            most_reached=most_reached, splits=splits,
        )
    cold_links = links.join(sizes, "__group", "left_anti") if has_hot else links
    pairs = (
        cold_links.join(members, "__group")
        .groupBy("__key", "__member")
        .agg(F.min(F.greatest("__f", "__g")).alias("__h"))
    )
    events = pairs.select("__key", F.col("__h").alias("__e"), _one().alias("x"))
    if has_hot:
        hot_links = links.join(sizes, "__group", "left_semi")
        hot_members = members.join(sizes, "__group", "left_semi")
        both = (
            pairs.join(hot_links, "__key")
            .join(hot_members, ["__group", "__member"])
            .groupBy("__key", "__member", "__h")
            .agg(F.min(F.greatest("__f", "__g")).alias("__via_hot"))
        )
        events = events.unionByName(
            both.select("__key", F.greatest("__h", "__via_hot").alias("__e"), _one(-1).alias("x"))
        )
    cold = as_of_state(
        asked, events, row_key=row_key, keys=["__rk"], at=F.col("__ask"), child_keys=["__key"],
        child_at=F.col("__e"), adds={"x": F.col("x")}, splits=splits,
    ).select(*row_key, F.coalesce(F.col("x"), _one(0)).alias(name))
    if not has_hot:
        return cold

    own = hot_links.groupBy(F.col("__key").alias("__rk")).agg(F.sort_array(F.collect_list(F.struct("__f", "__group"))).alias("__own"))
    signed = asked.join(own, "__rk", "left").select(
        *row_key, "__ask",
        F.sort_array(
            F.transform(F.filter("__own", lambda s: s["__f"] <= F.col("__ask")), lambda s: s["__group"])
        ).alias("__sig"),
    ).where(F.size("__sig") > 0)
    hot, _ = _unions(signed, hot_members, list(row_key), splits)
    return cold.join(hot, list(row_key), "left").select(
        *row_key, (F.col(name) + F.coalesce(F.col("__hot"), _one(0))).alias(name)
    )


def _unions(signed: DataFrame, members: DataFrame, row_key: list[str], splits: int) -> tuple[DataFrame, DataFrame]:
    """Members of the union of each row's groups ``__sig`` by its instant, and the unions' members with first times."""
    reached = (
        signed.select("__sig").distinct()
        .select("__sig", F.explode("__sig").alias("__group"))
        .join(members, "__group")
        .groupBy("__sig", "__member")
        .agg(F.min("__g").alias("__g"))
    )
    counted = as_of_state(
        signed, reached, row_key=row_key, keys=["__sig"], at=F.col("__ask"), child_keys=["__sig"],
        child_at=F.col("__g"), adds={"y": _one()}, splits=splits,
    )
    return counted.select(*row_key, F.coalesce(F.col("y"), _one(0)).alias("__hot")), reached


def _reached_by_few(
    asked: DataFrame, links: DataFrame, members: DataFrame, *, row_key: list[str], name: str, hot: DataFrame | None,
    few_rows: int, most_reached: int | None, splits: int,
) -> DataFrame:
    """``reach_counts`` of keys that are asked a few times each: arrays of members per row and group."""
    steps = (
        asked.where(F.col("__rk").isNotNull())
        .join(links.withColumnRenamed("__key", "__rk"), "__rk")
        .where(F.col("__f") <= F.col("__ask"))
        .select(*row_key, "__ask", "__group")
    )
    shared = None
    if hot is not None:
        own = steps.join(hot, "__group", "left_semi").groupBy(*row_key, "__ask").agg(
            F.sort_array(F.collect_list("__group")).alias("__sig")
        )
        often = own.groupBy("__sig").count().where(F.col("count") > few_rows).select("__sig")
        if len(often.limit(1).collect()) > 0:
            shared = own.join(often, "__sig", "left_semi")
            steps = (
                steps.join(hot.withColumn("__hot", F.lit(True)), "__group", "left")
                .join(shared.select(*row_key, F.lit(True).alias("__shared")), row_key, "left")
                .where(F.col("__hot").isNull() | F.col("__shared").isNull())
                .select(*row_key, "__ask", "__group")
            )
    counted = _count_arrays(steps, members, row_key, most_reached)
    total = F.coalesce("__x", _one(0))
    out = asked.join(counted, row_key, "left")
    if shared is not None:
        union, reached = _unions(shared, members.join(hot, "__group", "left_semi"), row_key, splits)
        twice = (
            steps.join(shared.select(*row_key, "__sig"), row_key)
            .join(members.withColumnRenamed("__g", "__own_g"), "__group")
            .where(F.col("__own_g") <= F.col("__ask"))
            .select(*row_key, "__sig", "__ask", "__member").distinct()
            .join(reached, ["__sig", "__member"])
            .where(F.col("__g") <= F.col("__ask"))
            .groupBy(*row_key).agg(F.count("*").alias("__twice"))
        )
        out = out.join(union, row_key, "left").join(twice, row_key, "left")
        total = total + F.coalesce("__hot", _one(0)) - F.coalesce("__twice", _one(0))
    return out.select(*row_key, total.alias(name))


def _count_arrays(steps: DataFrame, members: DataFrame, row_key: list[str], most: int | None) -> DataFrame:
    """(row_key, __x): distinct members visible by ``__ask`` over a row's groups.

    No array holds more than about ARRAY_ROWS members: members of larger groups are dealt to several arrays by
    hash, and so are the members of a row that reaches more.
    """
    piece, chunk = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    if most is None or most > ARRAY_ROWS:
        counts = members.groupBy("__group").agg(F.count("*").alias("__b"))
        members = members.join(counts, "__group").withColumn("__chunks", F.ceil(F.col("__b") / ARRAY_ROWS))
        chunk = F.pmod(F.xxhash64("__member"), F.col("__chunks"))
        totals = steps.join(counts, "__group").groupBy(*row_key).agg(F.ceil(F.sum("__b") / ARRAY_ROWS).alias("__pieces"))
        steps = steps.join(totals, row_key)
    lists = members.groupBy("__group", chunk.alias("__chunk")).agg(
        F.sort_array(F.collect_list(F.struct("__member", "__g"))).alias("__list")
    ).drop("__chunk")
    seen = F.transform(F.filter("__list", lambda m: m["__g"] <= F.col("__ask")), lambda m: m["__member"])
    met = steps.join(lists, "__group")
    if "__pieces" in steps.columns:
        part = lambda i: F.filter("__seen", lambda m: F.pmod(F.xxhash64(m), F.col("__pieces")) == i)
        parts = F.when(F.col("__pieces") == 1, F.array("__seen")).otherwise(
            F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("__pieces") - 1), part)
        )
        met = met.withColumn("__seen", seen).select(*row_key, F.posexplode(parts).alias("__piece", "__seen"))
    else:
        met = met.select(*row_key, piece.alias("__piece"), seen.alias("__seen"))
    return (
        met.where(F.size("__seen") > 0)
        .groupBy(*row_key, "__piece")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("__seen")))).cast("bigint").alias("__x"))
        .groupBy(*row_key).agg(F.sum("__x").alias("__x"))
    )


def co_occurrence(
    target: DataFrame,
    links: DataFrame,
    *,
    row_key: Sequence[str],
    key: str,
    target_time: str,
    member: str,
    group: str,
    time: str,
    cutoff: str = "strict",
    hot_pairs: int = 250_000,
    splits: int | None = None,
) -> DataFrame:
    """Partners met in shared groups, and mean/max group size weighted by the partners seen.

    A partner counts once it and the key have both joined a group, each at its own first link time to it;
    the member itself counts among its partners. A group's size is that of its members by the cutoff.
    """
    when = effective(as_time(links, time), cutoff)
    rows = links.select(F.col(member).alias("__key"), F.col(group).alias("__group"), when.alias("__f")).dropna()
    single = rows.groupBy("__key", "__group").agg(F.min("__f").alias("__own_f"))
    counted = single.groupBy("__group").agg(F.count("*").alias("__size"))
    at = as_time(target, target_time)
    bounds = {}
    if splits is None:
        splits, top = measure_groups((target, [key], "k"), (target, [key], "t"), (links, [member], "k"), (links, [group], "g"))
        bounds = {"most_pairs": top["g"] ** 2, "most_asked": top["t"], "most_reached": top["k"] * top["g"]}
    partners = reach_counts(
        target, single.select("__key", "__group", F.col("__own_f").alias("__f")),
        single.select("__group", F.col("__key").alias("__member"), F.col("__own_f").alias("__g")),
        row_key=row_key, key=key, at=at, name="partners", hot_pairs=hot_pairs, splits=splits,
        sizes=counted.select("__group", (F.col("__size") * F.col("__size")).alias("__pairs")), **bounds,
    )
    # a group's size at each cutoff of a member: one lookup per (distinct cutoff, group joined before it)
    asked = target.select(*row_key, F.col(key).alias("__key"), at.alias("__ask"))
    seen = asked.select("__key", "__ask").dropna().distinct().join(single, "__key").where(F.col("__own_f") <= F.col("__ask"))
    seen = seen.select("__key", "__group", "__ask")
    sized = as_of_state(
        seen, single, row_key=["__key", "__group", "__ask"], keys=["__group"], at=F.col("__ask"), child_keys=["__group"],
        child_at=F.col("__own_f"), adds={"__n": _one()}, splits=splits,
    )
    sizes = sized.groupBy("__key", "__ask").agg(F.sum("__n").alias("s1"), F.sum(F.col("__n") * F.col("__n")).alias("s2"), F.max("__n").alias("mx"))
    return partners.join(
        asked.join(sizes, ["__key", "__ask"], "left").select(
            *row_key,
            F.coalesce(F.col("s2") / F.col("s1"), F.lit(0.0)).alias("mean_group_size"),
            F.coalesce(F.col("mx"), _one(0)).alias("max_group_size"),
        ),
        list(row_key),
    )
