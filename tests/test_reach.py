"""Distinct members reached through groups: arrays in place of pairs, shared sets of large groups, shuffle sizes."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import history, paths, scan
from tidemark.plans import temporal_queries
from tests.conftest import rows


def reached(spark, hot_pairs, asks=3, **kw):
    rng = random.Random(5)
    links = [(k, g, rng.randrange(20)) for k in range(60) for g in rng.sample(range(9), 3)]
    links += [(k, 100 + g, 0) for k in range(60) for g in (range(3) if k < 40 else ())]  # 40 keys share a set
    members = [(g, m, rng.randrange(20)) for g in [*range(9), 100, 101, 102] for m in rng.sample(range(50), 20 if g > 99 else 6)]
    target = [(f"{k}-{i}", k, rng.randrange(22)) for k in range(70) for i in range(asks)]
    out = history.reach_counts(
        spark.createDataFrame(target, "row string, k int, t int"), spark.createDataFrame(links, "__key int, __group int, __f int"),
        spark.createDataFrame(members, "__group int, __member int, __g int"), row_key=["row"], key="k", at=F.col("t"), name="n",
        splits=1, hot_pairs=hot_pairs, **kw,
    )
    by_group = {}
    for g, m, t in members:
        by_group.setdefault(g, []).append((m, t))
    want = [
        (r, len({m for key, g, f in links if key == k and f <= t for m, s in by_group[g] if s <= t})) for r, k, t in target
    ]
    return out, sorted(want)


@pytest.mark.parametrize("hot_pairs", [10**9, 300, 100, 0])
@pytest.mark.parametrize("array_rows", [10**6, 4])
def test_reached_by_arrays_equals_brute_force(spark, monkeypatch, hot_pairs, array_rows):
    monkeypatch.setattr(history, "ARRAY_ROWS", array_rows)
    out, want = reached(spark, hot_pairs)
    assert rows(out) == want


def test_keys_asked_often_equal_brute_force(spark):
    out, want = reached(spark, 300, asks=6)
    assert rows(out) == want


def test_no_pair_of_row_and_member_is_shuffled(spark, capsys):
    out, _ = reached(spark, 10**9)
    out.explain()
    assert not re.search(r"hashpartitioning\((row|__key|__rk)#\d+L?, __member#", capsys.readouterr().out)


def test_shuffle_partitions_follow_the_rows(spark):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(name, None)
    try:
        now = int(before or spark.conf.get("spark.sql.shuffle.partitions"))
        table = spark.range((now + 1) * scan.SHUFFLE_ROWS).select((F.col("id") % 1000).alias("k"))
        scan.choose_splits((table, ["k"], "k"))
        assert int(spark.conf.get(name)) == now + 1
        scan.choose_splits((table.limit(10), ["k"], "k"))
        assert int(spark.conf.get(name)) == now + 1
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def dated(spark, seed, null):
    """Targets whose keys are asked up to three times, and rows of (key, group, time, other key, value), each sometimes unknown."""
    rng = random.Random(seed)
    some = lambda v: None if rng.random() < null else v
    day = lambda: some(dt.datetime(2020, 1, 1) + dt.timedelta(days=rng.randrange(30)))
    target = [(r, some(r % 25), day()) for r in range(70)]
    links = [(some(rng.randrange(28)), some(rng.randrange(15)), day(), some(rng.randrange(20)), some(float(rng.randrange(9)))) for _ in range(120)]
    return spark.createDataFrame(target, "row int, k int, t timestamp_ntz"), spark.createDataFrame(links, "k int, g int, t timestamp_ntz, o int, v double")


@pytest.mark.parametrize(("cutoff", "lower", "window", "null"), [("strict", "inclusive", 9, 0.1), ("inclusive", "exclusive", 9, 0.1), ("strict", "exclusive", 0, 0.0), ("inclusive", "inclusive", 0, 0.1)])
def test_links_through_arrays_equal_running_states(spark, monkeypatch, cutoff, lower, window, null):
    target, base = dated(spark, 3, null)
    args = dict(
        row_key=["row"], key="k", target_time="t", own_key="k", own_item="g", own_time="t", incoming_item="g", incoming_source="o",
        incoming_time="t", window_days=window, cutoff=cutoff, lower=lower,
    )
    states = rows(paths.incoming_link_counts(target, base, base, **args, splits=1))
    monkeypatch.setattr(paths, "reach_counts", None)
    assert rows(paths.incoming_link_counts(target, base, base, **args)) == states
    assert sum(r[1] for r in states) > 100


@pytest.mark.parametrize("cutoff", ["strict", "inclusive"])
def test_pivots_through_arrays_equal_running_states(spark, monkeypatch, cutoff):
    target, base = dated(spark, 4, 0.1)
    args = dict(
        row_key=["row"], key="k", target_time="t", base_key="k", base_time="t", pivot="g", second_key="g", second_time="t", value="v", cutoff=cutoff,
    )
    states = rows(paths.pivot_history(target, base, base, **args, splits=1))
    monkeypatch.setattr(paths, "reach_counts", None)
    for one, other in zip(rows(paths.pivot_history(target, base, base, **args)), states, strict=True):
        assert one == pytest.approx(other)
    assert sum(r[2] for r in states) > 100


def test_large_groups_and_keys_asked_often_keep_running_states():
    assert paths._small({"t": 4, "k": 64, "s": 4096})
    assert not any(paths._small({"t": 4, "k": 64, "s": 4096} | {c: n}) for c, n in (("t", 5), ("k", 65), ("s", 4097)))


@pytest.mark.parametrize("query", ["incoming_links_customer", "pivot_history_part_customer"])
def test_joined_lines_are_written_once(spark, capsys, query):
    """After the join of lines and orders, one shuffle by key, one by group, one by target; the tables are not read again."""
    out = temporal_queries.QUERIES[query](spark, "/root/testdata/sf0.001")
    assert not any("lineitem.parquet" in f or "orders.parquet" in f for f in out.inputFiles())
    out.explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") <= 9  # 5 of them of targets only
