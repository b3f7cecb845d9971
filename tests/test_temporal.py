"""Hand cases, leakage mutation, skew and slicing: results must not depend on the physical route."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.operators import history, paths, scan, temporal

DAY0 = dt.datetime(2024, 1, 1)
SF = "/root/testdata/sf0.001"


def at(day, hour=0):
    return DAY0 + dt.timedelta(days=day, hours=hour)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows on one key, repeated instants, NULL keys, times and values."""
    e = spark.range(3000).select(
        F.col("id").alias("row"),
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 97 == 1, F.lit(None)).otherwise(F.col("id") % 41).cast("int").alias("k"),
        F.when(F.col("id") % 89 != 2, F.lit(DAY0).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), ((F.col("id") * 7919) % 1500).cast("int"))).alias("t"),
        F.when(F.col("id") % 11 != 3, ((F.col("id") * 31) % 101).cast("double")).alias("v"),
        F.concat(F.lit("c"), (F.col("id") * 13 % 7).cast("string")).alias("c"),
        (F.col("id") * 17 % 53).cast("int").alias("p"),
    )
    return e.cache()


def brute(df, cutoff="strict", windows=()):
    data = [r.asDict() for r in df.collect()]
    out = {}
    for r in data:
        past = [
            x for x in data
            if r["k"] is not None and r["t"] is not None and x["k"] == r["k"] and x["t"] is not None
            and (x["t"] < r["t"] or (cutoff == "inclusive" and x["t"] == r["t"]))
        ]
        out[r["row"]] = (r, past)
    return out


ARGS = dict(row_key=["row"], keys=["k"], target_time="t", child_keys=["k"], child_time="t")


@pytest.mark.parametrize("splits", [1, 5, 40])
@pytest.mark.parametrize("cutoff", ["strict", "inclusive"])
def test_point_in_time_equals_brute_force(spark, skewed, splits, cutoff):
    got = {r["row"]: r for r in temporal.point_in_time_features(skewed, skewed, value="v", prefix="h", cutoff=cutoff, splits=splits, **ARGS).collect()}
    want = brute(skewed, cutoff)
    assert set(got) == set(want)
    for key, (r, past) in want.items():
        vals = [x["v"] for x in past if x["v"] is not None]
        g = got[key]
        assert g["h_count"] == len(vals)
        if vals:
            mean = sum(vals) / len(vals)
            assert g["h_mean"] == pytest.approx(mean)
            assert g["h_std"] == pytest.approx((sum((x - mean) ** 2 for x in vals) / len(vals)) ** 0.5, abs=1e-6)
            assert g["h_max"] == max(vals)
            last = max(x["t"] for x in past if x["v"] is not None)
            assert g["h_days_since_last"] == (r["t"].date() - last.date()).days >= 0
        else:
            assert g["h_mean"] is None and g["h_mean__is_missing"] == 1


@pytest.mark.parametrize("splits", [1, 7])
@pytest.mark.parametrize("lower", ["exclusive", "inclusive"])
def test_lookback_windows_equal_brute_force(spark, skewed, splits, lower):
    out = temporal.lookback_features(
        skewed, skewed, value="v", prefix="w", windows_days=(5, 20), cutoff="strict", lower=lower, tiebreak=["row"], splits=splits, **ARGS
    )
    got = {r["row"]: r for r in out.collect()}
    for key, (r, past) in brute(skewed).items():
        for w in (5, 20):
            low = r["t"] - dt.timedelta(days=w) if r["t"] else None
            vals = [x["v"] for x in past if x["v"] is not None and (x["t"] > low or (lower == "inclusive" and x["t"] == low))]
            assert got[key][f"w_recent_{w}d_count"] == len(vals)
            if vals:
                assert got[key][f"w_recent_{w}d_mean"] == pytest.approx(sum(vals) / len(vals))
            else:
                assert got[key][f"w_recent_{w}d_mean"] is None
        if past:
            last = max(past, key=lambda x: (x["t"], x["row"]))
            assert got[key]["w_last_value"] == last["v"]


@pytest.mark.parametrize("splits", [1, 6])
def test_distinct_history_equals_brute_force(spark, skewed, splits):
    out = history.distinct_history(skewed, skewed, items={"p": "p", "c": "c"}, window_item="p", windows_days=(4, 15), splits=splits, **ARGS)
    got = {r["row"]: r for r in out.collect()}
    for key, (r, past) in brute(skewed).items():
        assert got[key]["p_distinct"] == len({x["p"] for x in past})
        assert got[key]["c_distinct"] == len({x["c"] for x in past})
        for w in (4, 15):
            assert got[key][f"p_distinct_{w}d"] == len({x["p"] for x in past if x["t"] >= r["t"] - dt.timedelta(days=w)})


@pytest.mark.parametrize("splits", [1, 6])
def test_category_state_equals_brute_force(spark, skewed, splits):
    import math
    from collections import Counter

    out = history.category_state(skewed, skewed, category="c", tiebreak=["row"], splits=splits, **ARGS)
    got = {r["row"]: r for r in out.collect()}
    for key, (_, past) in brute(skewed).items():
        n = Counter(x["c"] for x in past)
        total = sum(n.values())
        assert got[key]["category_majority_confidence"] == pytest.approx(max(n.values()) / total if total else 0.0)
        assert got[key]["category_entropy"] == pytest.approx(-sum(v / total * math.log(v / total) for v in n.values()) if total else 0.0, abs=1e-9)
        last = max(past, key=lambda x: (x["t"], x["row"]))["c"] if past else None
        assert got[key]["category_latest"] == last


@pytest.mark.parametrize("own_times", [False, True])
@pytest.mark.parametrize("hot", [10**9, 20, 0])
def test_co_occurrence_with_hot_groups_equals_brute_force(spark, hot, own_times):
    links = spark.range(400).select(
        "id",
        (F.col("id") * 7 % 29).cast("int").alias("m"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") * 5 % 23).cast("int").alias("g"),
    ).withColumn("t", F.lit(DAY0).cast("timestamp_ntz") + F.make_dt_interval((F.col("id") * 5 % 19 if own_times else F.col("g") * 5 % 19).cast("int")))
    target = spark.range(60).select(
        F.col("id").alias("row"), (F.col("id") % 31).cast("int").alias("k"),
        (F.lit(DAY0).cast("timestamp_ntz") + F.make_dt_interval((F.col("id") * 3 % 25).cast("int"))).alias("t"),
    )
    out = history.co_occurrence(target, links, row_key=["row"], key="k", target_time="t", member="m", group="g", time="t", hot_pairs=hot)
    got = {r["row"]: r for r in out.collect()}
    data = [r.asDict() for r in links.drop("id").distinct().collect()]
    for r in target.collect():
        seen = [x for x in data if x["t"] < r["t"]]  # a partner that joins later is not known yet
        mine = {x["g"] for x in data if x["m"] == r["k"] and x["t"] < r["t"]}
        sizes = {g: len({x["m"] for x in seen if x["g"] == g}) for g in mine}
        assert got[r["row"]]["partners"] == len({x["m"] for x in seen if x["g"] in mine})
        want = sum(n * n for n in sizes.values()) / sum(sizes.values()) if mine else 0.0
        assert got[r["row"]]["mean_group_size"] == pytest.approx(want)
        assert got[r["row"]]["max_group_size"] == max(sizes.values(), default=0)


@pytest.mark.parametrize("splits", [1, 4])
@pytest.mark.parametrize("hot", [10**9, 10])
def test_pivot_history_hot_and_sliced(spark, skewed, splits, hot):
    small = skewed.where("row < 600")
    target = small.where("row % 5 = 0").select("row", "k", "t")
    out = paths.pivot_history(
        target, small, small, row_key=["row"], key="k", target_time="t", base_key="k", base_time="t", pivot="p",
        second_key="p", second_time="t", value="v", hot_pairs=hot, splits=splits,
    )
    got = {r["row"]: r for r in out.collect()}
    data = [r.asDict() for r in small.collect()]
    for r in target.collect():
        g = got[r["row"]]
        seen = [x for x in data if r["t"] and r["k"] is not None and x["k"] == r["k"] and x["t"] and x["t"] < r["t"]]
        piv = {x["p"] for x in seen}
        second = [x for x in data if x["p"] in piv and x["t"] and x["t"] < r["t"]]
        vals = [x["v"] for x in second if x["v"] is not None]
        assert g["pivot_pivot_nunique"] == len(piv)
        assert g["pivot_count"] == len(vals)
        assert g["pivot_nunique"] == len(set(vals))
        if vals:
            assert g["pivot_max"] == max(vals)
            assert g["pivot_mean"] == pytest.approx(sum(vals) / len(vals))


@pytest.mark.parametrize(("hot", "points", "splits"), [(10**9, 10**9, 1), (10, 5, 1), (10, 5, 4)])
def test_incoming_links_equal_brute_force(spark, skewed, hot, points, splits):
    small = skewed.where("row < 600")
    target = small.where("row % 5 = 0").select("row", "k", "t")
    out = paths.incoming_link_counts(
        target, small, small, row_key=["row"], key="k", target_time="t", own_key="k", own_item="p", own_time="t", incoming_item="p",
        incoming_source="c", incoming_time="t", window_days=9, hot_pairs=hot, splits=splits,
    )
    got = {r["row"]: r for r in out.collect()}
    data = [r.asDict() for r in small.collect()]
    for r in target.collect():
        seen = [x for x in data if r["t"] and r["k"] is not None and x["k"] == r["k"] and x["t"] and x["t"] < r["t"]]
        refs = [x for x in data if x["p"] in {y["p"] for y in seen} and x["t"] and x["t"] < r["t"]]
        assert got[r["row"]]["incoming_count"] == len(refs)
        assert got[r["row"]]["incoming_sources"] == len({x["c"] for x in refs})
        assert got[r["row"]]["incoming_count_9d"] == len([x for x in refs if x["t"] >= r["t"] - dt.timedelta(days=9)])


def test_future_rows_never_change_a_feature(spark, skewed):
    """Mutation: rewriting everything after a row's cutoff leaves the row's features alone."""
    cut = at(30)
    target = skewed.where(F.col("t") <= F.lit(cut).cast("timestamp_ntz"))
    future = skewed.withColumn("v", F.when(F.col("t") > F.lit(cut).cast("timestamp_ntz"), F.lit(1e6)).otherwise(F.col("v"))).withColumn(
        "c", F.when(F.col("t") > F.lit(cut).cast("timestamp_ntz"), F.lit("poison")).otherwise(F.col("c"))
    )
    for cutoff in ("strict", "inclusive"):
        fns = [
            lambda c: temporal.point_in_time_features(target, c, value="v", prefix="h", cutoff=cutoff, splits=1, **ARGS).drop("h_std", "h_mean"),
            lambda c: temporal.latest_value(target, c, value="v", prefix="l", cutoff=cutoff, splits=1, **ARGS),
            lambda c: history.category_state(target, c, category="c", tiebreak=["row"], cutoff=cutoff, splits=1, **ARGS),
            lambda c: history.distinct_history(target, c, items={"c": "c"}, window_item="c", cutoff=cutoff, splits=1, **ARGS),
        ]
        for fn in fns:
            assert rows(fn(skewed)) == rows(fn(future))


def test_result_does_not_depend_on_partitioning(spark, skewed):
    fn = lambda d: temporal.lookback_counts(d, d, prefix="x", **ARGS)
    assert rows(fn(skewed)) == rows(fn(skewed.repartition(13, "row")))


def test_measured_splits_take_the_sliced_route(spark, skewed):
    assert scan.choose_splits((skewed, ["k"], "k")) == 1
    n = scan.choose_splits((skewed, ["k"], "k"), rows_per_task=200)
    assert n == scan.BY_SIZE


def test_slices_by_size_follow_the_table(spark, skewed, monkeypatch):
    known = skewed.where("k is not null and t is not null").select("k", "t").distinct()
    assert scan.with_slice(known, "t", ["k", "t"], scan.BY_SIZE).select(scan.SLICE).distinct().count() == 1
    monkeypatch.setattr(scan, "ROWS_PER_TASK", 20)
    sizes = [r["count"] for r in scan.with_slice(known, "t", ["k", "t"], scan.BY_SIZE).groupBy("k", scan.SLICE).count().collect()]
    assert max(sizes) < known.count() / 4


def test_slices_are_balanced_under_a_hot_key(spark, skewed):
    known = skewed.where("k is not null and t is not null").select("k", "t").distinct()
    sizes = [r["count"] for r in scan.with_slice(known, "t", ["k", "t"], 16).groupBy("k", scan.SLICE).count().collect()]
    assert max(sizes) < known.count() / 4


def test_lenient_links_admit_unknown_times(spark):
    links = spark.createDataFrame([(1, 10, None), (1, 11, at(5)), (1, 12, at(50))], "k int, s int, t timestamp_ntz")
    target = spark.createDataFrame([(1, 1, at(10)), (2, 1, None), (3, 9, at(10))], "row int, k int, t timestamp_ntz")
    out = paths.link_counts(target, links, row_key=["row"], keys=["k"], target_time="t", link_keys=["k"], link_time="t", second_key="s")
    got = {r["row"]: (r["link_count"], r["link_days_since_last"], r["link_days_since_last__is_missing"]) for r in out.collect()}
    assert got == {1: (2, 5.0, 0), 2: (3, 0.0, 1), 3: (0, 0.0, 1)}


def test_no_window_spans_a_whole_key_when_sliced(spark, skewed):
    out = temporal.point_in_time_features(skewed, skewed, value="v", prefix="h", splits=9, **ARGS)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_point_in_time_is_one_exchange_on_the_key(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    out = temporal.point_in_time_features(
        o, o, row_key=["o_orderkey"], keys=["o_custkey"], target_time="o_orderdate", child_keys=["o_custkey"],
        child_time="o_orderdate", value="o_totalprice", prefix="h", splits=1,
    )
    plan = out._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquery")[0]
    assert main.count("Exchange hashpartitioning") == 1
    assert "IsNotNull(o_totalprice)" in plan and "o_orderstatus" not in plan


def test_lookups_in_a_hot_pivot_are_sliced(spark, monkeypatch):
    """One pivot, few base rows, many cutoffs: the lookups that meet in the pivot are what must be split."""
    base = spark.range(40).select((F.col("id") % 20).alias("k"), F.lit(1).alias("p"), F.lit(DAY0).cast("timestamp_ntz").alias("t"), F.col("id").cast("double").alias("v"))
    base = base.unionAll(spark.range(300).select(F.lit(99), F.lit(1), (F.lit(DAY0).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))), F.col("id").cast("double")))
    target = spark.range(2000).select(F.col("id").alias("row"), (F.col("id") % 20).alias("k"), (F.lit(DAY0).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("id") % 397).cast("int"))).alias("t"))
    args = {"row_key": ["row"], "key": "k", "target_time": "t", "base_key": "k", "base_time": "t", "pivot": "p", "second_key": "p", "second_time": "t", "value": "v"}
    plain = rows(paths.pivot_history(target, base, base, **args))
    monkeypatch.setattr(scan, "ROWS_PER_TASK", 50)
    for a, b in zip(rows(paths.pivot_history(target, base, base, **args, splits=1)), plain, strict=True):
        assert a == pytest.approx(b)
