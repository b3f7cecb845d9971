import datetime as dt
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.operators import dependency as dep

T = lambda s: dt.datetime.fromisoformat(s)


def entity_rows(spark, found):
    """(shop, since, owner) of every version of two shops; ``found`` is checked by owner."""
    return spark.createDataFrame([(s, T(t), o) for s, t, o in found], "shop int, since timestamp_ntz, owner string")


def test_only_entities_of_the_split_are_fitted(spark):
    e = spark.createDataFrame([(s, o) for s, o in zip(range(10, 70, 10), "ppqqrs", strict=True)], "shop int, owner string")
    t = spark.createDataFrame([(60, 1), (20, 0), (20, 1), (None, 0), (99, 1), (60, 0)], "shop int, label int")
    fit = dep.train_visible_rows(e, t, entity_key="shop", target_key="shop")
    assert rows(fit.select("shop", "owner")) == [(20, "p"), (60, "s")]
    m = dep.fit_manifest(e, t, fit, entity_key="shop", target_key="shop").first()
    assert (m["source_rows"], m["train_entities"], m["fit_rows"]) == (6, 3, 2)


def test_versions_end_at_the_last_cutoff_of_their_entity(spark):
    how = dict(entity_key="shop", target_key="place", entity_time="since", target_time="asked")
    e = entity_rows(spark, [(7, "2019-05-04", "first"), (7, "2019-08-20", "next"), (7, "2020-02-29", "late"), (8, "2018-12-31", "only"), (8, "2019-07-02", "late")])
    asked = lambda found: spark.createDataFrame([(s, T(t)) for s, t in found], "place int, asked timestamp_ntz")
    fit = dep.train_visible_rows(e, asked([(8, "2019-07-01"), (7, "2019-08-20")]), **how)
    assert rows(fit.select("shop", "owner")) == [(7, "first"), (7, "next"), (8, "only")]
    e = entity_rows(spark, [(3, "2021-11-05", "one"), (3, "2021-11-07", "two"), (3, "2021-11-30", "three"), (4, "2021-01-01", "unasked")])
    fit = dep.train_visible_rows(e, asked([(3, "2021-11-29"), (3, "2021-11-06"), (3, "2021-11-08")]), **how)
    assert rows(fit.select("owner")) == [("one",), ("two",)]


def test_fit_errors(spark):
    e = spark.createDataFrame([(5, "open")], "shop int, state string")
    t = spark.createDataFrame([(6, 1)], "shop int, label int")
    with pytest.raises(ValueError, match="must either both be provided"):
        dep.train_visible_rows(e, t, entity_key="shop", target_key="shop", target_time="label")
    with pytest.raises(ValueError, match="missing columns"):
        dep.train_visible_rows(e, t, entity_key="shop", target_key="place")
    with pytest.raises(ValueError, match="fit table is empty"):
        dep.require_rows(dep.train_visible_rows(e, t, entity_key="shop", target_key="shop"))


def brute_pair(found, i, j):
    """Statistics of one ordered pair of columns, counted by hand."""
    valid = [(r[i], r[j]) for r in found if r[i] is not None and r[j] is not None]
    n, left, right, both = len(valid), Counter(x for x, _ in valid), Counter(a for _, a in valid), Counter(valid)
    if not n:
        return None
    two = lambda k: k * (k - 1) / 2
    entropy = lambda counts: -sum(c / n * math.log(c / n) for c in counts)
    h = entropy(right.values())
    lhs_pairs, same = sum(map(two, left.values())), sum(map(two, both.values()))
    return {
        "n_valid": n, "coverage": n / len(found), "r_del": sum(max(c for (x, _), c in both.items() if x == v) for v in left) / n,
        "r_ent": 1 - (entropy(both.values()) - entropy(left.values())) / h if h > 1e-12 else 1.0,
        "r_pair": same / lhs_pairs if lhs_pairs else None,
        "r_tuple": 1 - sum(left[v] for v in left if sum(x == v for x, _ in both) > 1) / n,
        "lhs_uniqueness": len(left) / n, "lhs_support_repeated": sum(c for c in left.values() if c > 1) / n,
        "n_lhs_values": len(left), "n_rhs_values": len(right), "rhs_entropy": h,
    }


@pytest.mark.parametrize(("cells", "wide", "most"), [(1 << 16, 1 << 14, 1_000), (0, 0, 1_000), (0, 15, 1_000), (0, 0, 40), (0, 15, 40), (0, 200, 25)])
def test_every_route_counts_all_pairs(spark, monkeypatch, cells, wide, most):
    """A unique column, a hot value, nulls, arrays, texts and times, by closed form, in the map tasks or dealt by value."""
    monkeypatch.setattr(dep, "LIGHT_CELLS", cells)
    monkeypatch.setattr(dep, "LIGHT_ROWS", 50 if not cells else 8)
    monkeypatch.setattr(dep, "WIDE_VALUES", wide)
    rng = random.Random(5)
    found = []
    for k in range(300):
        hot = rng.random() < 0.4
        found.append((
            k, None if rng.random() < 0.1 else "hot" if hot else f"t{rng.randrange(60)}", None if k % 7 == 0 else -1 if hot else rng.randrange(90),
            rng.choice([None, 0.5, -1.25, 1e300]), (k % 3, 1) if k % 11 else None, T("2020-01-01") + dt.timedelta(days=rng.randrange(120)), None if k % 2 else k, None,
        ))
    kinds = "u long, t string, i int, d double, l array<int>, w timestamp_ntz, half int, none string"
    d = spark.createDataFrame([tuple(list(v) if isinstance(v, tuple) else v for v in r) for r in found], kinds)
    got = {(r["lhs"], r["rhs"]): r.asDict() for r in dep.pair_statistics(d, d.columns, rows_per_task=most).collect()}
    assert len(got) == 56
    for i, x in enumerate(d.columns):
        for j, a in enumerate(d.columns):
            if i != j:
                want = brute_pair(found, i, j)
                mine = got[(x, a)]
                assert mine["n_valid"] == (want["n_valid"] if want else 0) and mine["n_total"] == 300
                assert not want or {c: mine[c] for c in want} == pytest.approx(want, abs=1e-9), (x, a)


def test_weights_take_the_same_routes(spark, monkeypatch):
    d = spark.range(200).select("id", (F.col("id") % 7).alias("x"), (F.col("id") * 13 % 90).alias("a"), F.col("id").cast("string").alias("u"))
    how = dict(row_key=["id"], replicates=3)
    plain = rows(dep.calibration_statistics(d, ["x", "a", "u"], **how))
    for wide in (0, 50):
        monkeypatch.setattr(dep, "LIGHT_CELLS", 0)
        monkeypatch.setattr(dep, "LIGHT_ROWS", 1_000)
        monkeypatch.setattr(dep, "WIDE_VALUES", wide)
        for one, other in zip(rows(dep.calibration_statistics(d, ["x", "a", "u"], **how)), plain, strict=True):
            assert one == pytest.approx(other)


def test_empty_table_has_pairs_without_rows(spark):
    d = spark.createDataFrame([], "x string, a int")
    assert rows(dep.pair_statistics(d, ["x", "a"]).select("lhs", "rhs", "n_valid")) == [("a", "x", 0), ("x", "a", 0)]


def test_pair_statistics_by_hand(spark):
    d = spark.createDataFrame([("p", "1"), ("p", "1"), ("p", "2"), ("q", "3"), ("r", None), (None, "1")], "x string, a string")
    s = {(r["lhs"], r["rhs"]): r for r in dep.pair_statistics(d, ["x", "a"]).collect()}[("x", "a")]
    assert (s["n_total"], s["n_valid"], s["n_lhs_values"], s["n_rhs_values"]) == (6, 4, 2, 3)
    assert s["r_del"] == pytest.approx(3 / 4)
    assert s["r_tuple"] == pytest.approx(1 / 4)
    assert s["r_pair"] == pytest.approx(1 / 3)
    assert s["lhs_collision"] == pytest.approx(3 / 6)
    assert s["lhs_support_repeated"] == pytest.approx(3 / 4)
    h_a = -(0.5 * math.log(0.5) + 2 * 0.25 * math.log(0.25))
    h_ax = 0.75 * -(2 / 3 * math.log(2 / 3) + 1 / 3 * math.log(1 / 3))
    assert s["rhs_entropy"] == pytest.approx(h_a)
    assert s["r_ent"] == pytest.approx(1 - h_ax / h_a)
    assert not s["exact_fd"]


def test_pairs_without_common_rows_are_reported(spark):
    d = spark.createDataFrame([("p", None), (None, "1")], "x string, a string")
    s = dep.pair_statistics(d, ["x", "a"]).collect()
    assert len(s) == 2
    assert all(r["n_valid"] == 0 and r["coverage"] == 0 and r["r_del"] is None and not r["exact_fd"] for r in s)


def test_constant_right_side_and_exact_dependency(spark):
    d = spark.createDataFrame([("p", "c"), ("q", "c"), ("q", "c")], "x string, a string")
    s = {(r["lhs"], r["rhs"]): r for r in dep.pair_statistics(d, ["x", "a"]).collect()}
    assert s[("x", "a")]["exact_fd"] and s[("x", "a")]["r_ent"] == 1.0
    assert s[("x", "a")]["rhs_entropy"] == 0.0


def test_label_and_ids_never_enter_an_edge(spark):
    d = spark.createDataFrame([(i, f"g{i % 3}", f"l{i % 3}", f"z{i % 3}") for i in range(30)], "id int, g string, y string, z string")
    e = dep.select_edges(dep.pair_statistics(d, d.columns), id_columns=["id"], label="y", k=9)
    assert rows(e.select("lhs", "rhs")) == [("g", "z"), ("z", "g")]


def test_no_edge_leaves_the_matrix_alone(spark):
    t = spark.createDataFrame([(1, 7)], "row int, e int")
    out = dep.ambiguity_features(t, t, t, [], row_key=["row"], target_key="e", entity_key="e", entity_order=["row"])
    assert out.columns == ["row"] and out.count() == 1


def test_array_symbols_group_by_content(spark):
    d = spark.createDataFrame([([1, 2], "a"), ([1, 2], "a"), ([3], "b")], "x array<int>, a string")
    m = dep.ambiguity_map(d, "x", "a")
    assert rows(m.select("lhs_value", "support_count")) == [("1|2", 2), ("3", 1)]


def test_fingerprint_ignores_order(spark):
    d = spark.range(100).withColumn("v", F.col("id") * 3)
    one, two = (dep.fingerprint(x, ["id", "v"]).first() for x in (d, d.orderBy(F.desc("id")).repartition(7)))
    assert one == two
    assert dep.fingerprint(d.withColumn("v", F.col("v") + (F.col("id") == 5).cast("int")), ["id", "v"]).first() != one


def test_ambiguity_reads_the_version_known_at_the_time(spark):
    day = lambda n: f"2024-{n:02d}-01 00:00:00"
    entity = spark.createDataFrame([(1, day(1), "a", "x"), (1, day(6), "b", "x"), (2, day(3), "a", "y")], "e int, t string, lhs string, rhs string")
    target = spark.createDataFrame([(0, 1, day(2)), (1, 1, day(7)), (2, 2, day(2)), (3, None, day(7)), (4, 1, None)], "row int, who int, cut string")
    entity, target = entity.withColumn("t", F.col("t").cast("timestamp_ntz")), target.withColumn("cut", F.col("cut").cast("timestamp_ntz"))
    how = {"row_key": ["row"], "target_key": "who", "entity_key": "e", "entity_order": ["lhs"]}
    out = dep.ambiguity_features(target, entity, entity, [("lhs", "rhs")], entity_time="t", target_time="cut", **how)
    assert rows(out.select("row", "f_amb__lhs_to_rhs__support_count")) == [(0, 2), (1, 1), (2, None), (3, None), (4, None)]
    with pytest.raises(ValueError, match="both"):
        dep.ambiguity_features(target, entity, entity, [("lhs", "rhs")], entity_time="t", **how)
