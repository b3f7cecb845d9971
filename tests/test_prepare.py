import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.functions import columns as col
from tidemark.operators import assemble, metrics, prepare, rank, runs, sample, scan


def test_expand_array_pads_short_rows(spark):
    d = spark.createDataFrame([(1, [1, 2, 3]), (2, [4]), (3, None)], "id int, a array<int>")
    assert rows(prepare.expand_array(d, "a")) == [(1, 1, 2, 3), (2, 4, None, None), (3, None, None, None)]


def test_numbers_never_fail(spark):
    d = spark.createDataFrame([("1.5",), ("x",), ("inf",), ("NaN",), (None,)], "s string")
    assert [r[0] for r in d.select(col.number("s")).collect()] == [1.5, None, None, None, None]


def test_labels(spark):
    d = spark.createDataFrame([("Yes ", 0.0), ("f", 2.5)], "w string, y double")
    assert rows(d.select(col.binary_label("w").alias("b"), col.log1p_label("y").alias("l")))[0][0] == 0
    with pytest.raises(Exception, match="not a binary label"):
        d.select(col.binary_label(F.lit("maybe"))).collect()
    with pytest.raises(Exception, match="not negative"):
        d.select(col.log1p_label("y")).unionAll(d.select(F.lit(-1.0).alias("y")).select(col.log1p_label("y"))).collect()


def test_canonical_classes_agree(spark):
    d = spark.createDataFrame([("6",), ("6.0",), (" 6.5",), ("abc",), (None,)], "c string")
    assert [r[0] for r in d.select(col.canonical_class("c")).collect()] == ["6", "6", "6.5", "abc", None]


def test_indicators_and_fill(spark):
    d = spark.createDataFrame([(1.0,), (None,)], "v double")
    assert rows(col.with_indicators(d, ["v"], fill=-999.0)) == [(-999.0, 1), (1.0, 0)]
    e = spark.createDataFrame([(float("inf"),), (None,), (2.0,)], "v double")
    assert rows(col.fill_numbers(e, ["v"])) == [(0.0,), (0.0,), (2.0,)]


def test_imputation_uses_train_only(spark):
    train = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (9.0, "b"), (None, None), (4.0, "a")], "x double, w string")
    val = spark.createDataFrame([(None, None), (100.0, "z")], train.schema)
    _, v = prepare.impute(train, [train, val], ["x"], ["w"])
    assert rows(v) == [(3.0, "a"), (100.0, "z")]


@pytest.mark.parametrize("splits", [2, 16, 64])
def test_exact_medians_any_slicing(spark, splits):
    d = spark.range(501).select((F.col("id") * 37 % 101).cast("double").alias("a"), (F.col("id") % 2).cast("double").alias("b"), (F.col("id") % 3).alias("g"))
    got = {r["feature"]: r["median"] for r in scan.exact_medians(d, ["a", "b"], splits=splits).collect()}
    want = d.agg(F.median("a"), F.median("b")).first()
    assert (got["a"], got["b"]) == tuple(want)
    by = {(r["g"], r["feature"]): r["median"] for r in scan.exact_medians(d, ["a"], ["g"], splits=splits).collect()}
    assert by == {(r["g"], "a"): r["m"] for r in d.groupBy("g").agg(F.median("a").alias("m")).collect()}


def test_joint_codes(spark):
    a, b = spark.createDataFrame([("b",), (None,)], "w string"), spark.createDataFrame([("a",), ("c",)], "w string")
    x, y = prepare.encode_jointly([a, b], ["w"])
    assert rows(x) == [(-1,), (1,)] and rows(y) == [(0,), (2,)]


def test_align(spark):
    a = spark.createDataFrame([(1, 2.0)], "x int, y double")
    assert prepare.align_columns(spark.createDataFrame([(5, 7)], "x int, z int"), a, 0.0).collect()[0].asDict() == {"x": 5, "y": 0.0}


def test_samples_are_exact_and_stable(spark):
    d = spark.range(5000).withColumn("c", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 11).cast("string")))
    small = rows(sample.hash_sample(d, 700, ["id"], 1))
    quota = spark.range(1).select(F.lit(700).cast("bigint").alias("quota"))
    assert small == rows(sample.hash_quota(d.repartition(9), ["id"], 1, [], quota))
    assert len(small) == 700 and small != rows(sample.hash_sample(d, 700, ["id"], 2))
    assert sample.hash_sample(d, 3000, ["id"], 1).count() == 3000
    assert sample.hash_sample(d, 9000, ["id"], 1).count() == 5000
    s = sample.stratified_sample(d, 300, "c", ["id"], 1).groupBy("c").count()
    assert {r["c"]: r["count"] for r in s.collect()}["hot"] == 100


def test_candidate_pairs(spark):
    pos = spark.createDataFrame([(1, [1, 2, 3]), (2, []), (3, None), (4, list(range(20))), (5, [1, 1])], "k int, items array<bigint>")
    u = spark.range(20)
    out = sample.candidate_pairs(pos, u, row_key=["k"], items="items", universe_item="id", seed=3)
    got = out.groupBy("k", "label").agg(F.count("*").alias("n"), F.count_distinct("candidate").alias("d")).collect()
    n = {(r["k"], r["label"]): (r["n"], r["d"]) for r in got}
    assert n == {(1, 1): (3, 3), (1, 0): (3, 3), (2, 0): (1, 1), (3, 0): (1, 1), (4, 1): (20, 20), (5, 1): (2, 1), (5, 0): (2, 2)}
    clash = out.where("label = 0").join(out.where("label = 1"), ["k", "candidate"])
    assert clash.count() == 0
    again = sample.candidate_pairs(pos.repartition(4), u.repartition(3), row_key=["k"], items="items", universe_item="id", seed=3)
    assert rows(again) == rows(out)


@pytest.mark.parametrize("splits", [1, 3, 50])
def test_auc_and_ap_any_slicing(spark, splits):
    d = spark.range(300).select(((F.col("id") * 29 % 41) / 41.0).alias("s"), (F.col("id") * 7 % 3 == 0).cast("int").alias("y"))
    pdf = [(r["s"], r["y"]) for r in d.collect()]
    p, n = [s for s, y in pdf if y], [s for s, y in pdf if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n))
    ap = sum(sum(y for s, y in pdf if s >= a) / sum(1 for s, _ in pdf if s >= a) for a in p) / len(p)
    m = metrics.binary_metrics(d, "y", "s", splits=splits).first()
    assert m["roc_auc"] == pytest.approx(auc) and m["average_precision"] == pytest.approx(ap)


def test_one_class_has_no_auc(spark):
    d = spark.createDataFrame([(0.2, 1), (0.4, 1)], "s double, y int")
    m = metrics.binary_metrics(d, "y", "s").first()
    assert m["roc_auc"] is None and m["average_precision"] == 1.0


def test_numbering_any_slicing(spark):
    d = spark.range(400).select((F.col("id") % 5 * 0).alias("k"), (F.col("id") * 73 % 401).alias("o"))
    for splits in (1, 4, 64):
        out = scan.numbered(d, ["k"], [F.col("o")], "n", splits=splits)
        assert [r["n"] for r in out.orderBy("o").collect()] == list(range(1, 401))


def test_many_splits_with_thinned_marks_stay_exact(spark):
    d = spark.range(300).select(F.lit(1).alias("k"), F.col("id").alias("o"))
    out = scan.numbered(d, ["k"], [F.col("o")], "n", splits=5000)
    assert [r["n"] for r in out.orderBy("o").collect()] == list(range(1, 301))


def test_column_helpers(spark):
    d = spark.createDataFrame([(1, 2.0, 3.0, 4)], "k int, f_amb__a double, ord_recent_30d_count double, x int")
    assert assemble.columns_of_block(d.columns, "fk_aggregation") == ["k", "ord_recent_30d_count", "x"]
    assert assemble.columns_of_block(d.columns, "ambiguity", ["k"]) == ["k", "f_amb__a"]
    assert assemble.random_columns(["a", "b", "c"], 2, 1) == assemble.random_columns(["c", "a", "b"], 2, 1)
    assert assemble.nested_budgets(["a", "b"], [1, 2], ["a", "b", "a__is_missing"]) == {1: ["a", "a__is_missing"], 2: ["a", "b", "a__is_missing"]}
    base, full = assemble.split_residual(d, ["x"])
    assert assemble.column_difference(full, base) == {"only_left": ["x"], "only_right": []}
    with pytest.raises(ValueError, match="missing columns"):
        assemble.split_residual(d, ["nope"])
    with pytest.raises(ValueError, match="overlapping"):
        assemble.assemble_blocks(d, [d], ["k"])
    m = assemble.feature_manifest(d, spark.createDataFrame([("x", "agg"), ("gone", "agg")], "feature string, block string"))
    assert {r["feature"]: r["materialised"] for r in m.collect()} == {"x": True, "gone": False}


def test_enrichment_must_agree(spark):
    t = spark.createDataFrame([(1, 5), (2, 6)], "k int, y int")
    s = spark.createDataFrame([(1, 10, 5)], "pk int, e int, y2 int")
    out = assemble.enrich_key(t, s, key="k", source_pk="pk", columns=["e", "y2"])
    check = assemble.enrich_check(out, [("y", "y2")], "e")
    assert check.first().asDict() == {"n_rows": 2, "unmatched": 1, "differs_y": 1}
    with pytest.raises(ValueError, match="does not verify"):
        assemble.require_agreement(check)


def test_display_order_and_rule_order(spark):
    d = spark.createDataFrame([("b",), ("z",), ("a",)], "v string")
    assert [r["v"] for r in runs.display_order(d, "v", ["b", "a"]).collect()] == ["b", "a", "z"]
    n = runs.normalise_variants(d, "v", {"A": "alias"}, [(["b"], "first"), (["b"], "second")])
    assert {r["v"]: r["variant_normalised"] for r in n.collect()} == {"a": "alias", "b": "first", "z": "z"}


def test_constant_features_score_minus_one(spark):
    d = spark.createDataFrame([(1.0, float(i), i % 2) for i in range(10)], "c double, v double, y int")
    s = {r["feature"]: r for r in rank.supervised_scores(d, ["c", "v"], "y").collect()}
    assert s["c"]["score_auc"] == s["c"]["score_ap"] == s["c"]["score_mi"] == -1.0
    assert s["v"]["roc_auc"] == pytest.approx(15 / 25)


def test_edge_quality_of_one_list(spark):
    e = spark.createDataFrame(
        [("a", "b", 3.0, 1, "ordinary"), ("id", "b", 2.0, 0, "surrogate"), ("c", "d", 1.0, 1, "ordinary"), ("d", "k", 0.5, 0, "constant")],
        "lhs string, rhs string, s double, truth int, kind string",
    )
    q = rank.edge_quality(e, "s", "truth", "kind", [2]).first()
    assert q["roc_auc"] == pytest.approx(0.75) and q["average_precision"] == pytest.approx((1 + 2 / 3) / 2)
    assert (q["tp_at_2"], q["precision_at_2"], q["recall_at_2"], q["surrogate_rate_at_2"], q["constant_rate_at_2"]) == (1, 0.5, 0.5, 0.5, 0.0)


def brute_information(found, neighbours):
    """Nearest-neighbour information of (class, value) rows, all distances compared."""
    harmonic = lambda n: sum(1 / j for j in range(1, n)) - 0.5772156649015329
    live = [(c, v) for c, v in found if sum(d == c for d, _ in found) > 1]
    if not live:
        return None
    sums = [0.0, 0.0, 0.0]
    for i, (c, v) in enumerate(live):
        own = sorted(abs(v - u) for j, (d, u) in enumerate(live) if d == c and j != i)
        k = min(neighbours, len(own))
        r = own[k - 1]
        m = sum(abs(v - u) < r * rank.INSIDE if r > 0 else u == v for _, u in live)
        for at, n in enumerate((k, len(own) + 1, m)):
            sums[at] += harmonic(n) / len(live)
    return max(harmonic(len(live)) + sums[0] - sums[1] - sums[2], 0.0)


@pytest.mark.parametrize(("neighbours", "block_rows", "splits"), [(3, 1_000_000, 1), (3, 4, 5), (1, 2, 3), (6, 7, 0)])
def test_neighbour_information_equals_brute_force(spark, neighbours, block_rows, splits):
    rng = random.Random(neighbours)
    found = []
    for _ in range(160):
        c = rng.choice("aaabbc")
        found.append((c, rng.gauss({"a": 0, "b": 2, "c": 5}[c], 1), float(rng.randrange(4)), float(rng.randrange(40)) / 8, 1.0))
    found += [("alone", 9.0, 9.0, 9.0, 9.0), ("two", -30.0, 7.0, 0.0, 1.0), ("two", 80.5, 7.0, 0.0, 1.0)]
    d = spark.createDataFrame(found, "y string, smooth double, tied double, mixed double, constant double").repartition(6)
    got = {r.feature: r.mi for r in rank.neighbour_information(d, d.columns[1:], "y", neighbours=neighbours, block_rows=block_rows, splits=splits).collect()}
    assert got == {name: pytest.approx(brute_information([(r[0], r[i]) for r in found], neighbours), abs=1e-9) for i, name in enumerate(d.columns) if i}
    assert got["smooth"] > 0.3 > got["constant"]


def test_neighbour_information_without_rows(spark):
    d = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "y string, v double")
    assert rank.neighbour_information(d, ["v"], "y").count() == 0
    assert rank.neighbour_information(d.limit(0), ["v"], "y").count() == 0
