import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.operators import assemble, learn, metrics
from tidemark.plans import file_queries, run_queries
from tidemark.sources import publish


def test_published_table_is_whole_and_listed(spark, tmp_path):
    d = spark.range(500).select("id", (F.col("id") % 4).cast("string").alias("part"), F.when(F.col("id") % 3 > 0, F.col("id") / 7).alias("v"), F.array("id").alias("many"))
    folder = f"{tmp_path}/table"
    manifest = publish.publish(d.repartition(5), folder, partition_by=["part"])
    assert manifest.agg(F.sum("n_rows")).first()[0] == 500
    assert rows(publish.read_published(spark, folder, d).select("id", "v")) == rows(d.select("id", "v"))
    assert {r.state for r in publish.verify(spark, folder, d).collect()} == {"same"}
    assert sorted(os.listdir(tmp_path)) == ["table"]  # nothing stands beside it
    with pytest.raises(ValueError, match="exists"):
        publish.publish(d, folder)
    publish.publish(d, f"{tmp_path}/checked", check_source=True)
    with pytest.raises(ValueError, match="differ"):
        publish.publish(d.withColumn("v", F.current_timestamp()), f"{tmp_path}/random", check_source=True)


def test_changed_missing_and_new_files_are_told(spark, tmp_path):
    d = spark.range(90).select("id", (F.col("id") * 2).alias("v")).repartition(3)
    folder = f"{tmp_path}/table"
    publish.publish(d, folder)
    files = sorted(f for f in os.listdir(f"{folder}/data") if f.endswith(".parquet"))
    assert len(files) == 3
    for f in files:
        hidden = f"{folder}/data/.{f}.crc"
        if os.path.exists(hidden):
            os.unlink(hidden)
    os.rename(f"{folder}/data/{files[0]}", f"{folder}/data/other.parquet")
    spark.range(5).select("id", F.lit(1).cast("bigint").alias("v")).coalesce(1).write.parquet(f"{tmp_path}/one")
    new = next(f for f in os.listdir(f"{tmp_path}/one") if f.endswith(".parquet"))
    os.replace(f"{tmp_path}/one/{new}", f"{folder}/data/{files[1]}")
    spark.catalog.clearCache()
    assert {r.file: r.state for r in publish.verify(spark, folder, d).collect()} == {files[0]: "missing", "other.parquet": "unlisted", files[1]: "changed", files[2]: "same"}


def test_a_table_without_rows_is_published(spark, tmp_path):
    d = spark.createDataFrame([], "id long, v string")
    assert publish.publish(d, f"{tmp_path}/none").count() == 0
    assert publish.read_published(spark, f"{tmp_path}/none", d).count() == 0


def test_nothing_appears_when_the_write_fails(spark, tmp_path):
    d = spark.range(10).withColumn("v", F.when(F.col("id") == 7, F.raise_error(F.lit("stop")).cast("int")).otherwise(1))
    with pytest.raises(Exception, match="stop"):
        publish.publish(d, f"{tmp_path}/table")
    assert not os.path.exists(f"{tmp_path}/table")


def test_written_blocks_join_without_an_exchange(spark):
    base = spark.range(3_000).select((F.col("id") % 1_000).alias("a"), F.floor(F.col("id") / 1_000).alias("b"), F.lit("x").alias("kept"))
    blocks = [base.where(f"a % {k} = 0").select("b", "a", (F.col("a") * k + F.col("b")).alias(f"f{k}"), F.lit(k).alias(f"g{k}")) for k in (2, 3, 5)]
    written = [assemble.write_block(d, ["a", "b"], name, buckets=4) for name, d in zip(("base", "two", "three", "five"), [base, *blocks], strict=True)]
    out = assemble.assemble_written(written[0], written[1:], ["a", "b"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 3
    assert rows(out) == rows(assemble.assemble_blocks(base, blocks, ["a", "b"]).select(*out.columns))
    with pytest.raises(ValueError, match="overlapping"):
        assemble.assemble_written(written[0], [written[1], written[1]], ["a", "b"])


def test_a_repeated_key_fails_the_write(spark):
    twice = spark.range(100).select((F.col("id") % 99).alias("k"), F.lit(1).alias("f"))
    with pytest.raises(Exception, match="repeated row key"):
        assemble.write_block(twice, ["k"], "twice", buckets=3)
    nulls = spark.createDataFrame([(None, 1), (None, 2)], "k int, f int")
    with pytest.raises(Exception, match="repeated row key"):
        assemble.write_block(nulls, ["k"], "nulls", buckets=2)


def newton(x, y, penalty):
    """Logistic regression with a ridge on standardised columns, by Newton's method."""
    scale = x.std(axis=0, ddof=1)
    scale[scale == 0] = np.inf
    z = np.c_[np.ones(len(x)), x / scale]
    w = np.zeros(z.shape[1])
    ridge = np.diag([0.0] + [penalty] * x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z.T * (p * (1 - p))) @ z / len(z) + ridge + 1e-12 * np.eye(len(w)), z.T @ (p - y) / len(z) + ridge @ w)
    return w, scale


def test_budget_curve_equals_a_fit_per_prefix(spark):
    rng = random.Random(4)
    found = []
    for k in range(400):
        a, b, c = rng.gauss(0, 1), rng.gauss(0, 2), rng.random()
        found.append((k, a, None if rng.random() < 0.2 else b, c, int(1.5 * a - 0.7 * b + rng.gauss(0, 1) > 0)))
    d = spark.createDataFrame(found, "id long, a double, b double, c double, y int")
    train, val = d.where("id < 250"), d.where("id >= 250")
    got = {r.budget: r for r in learn.budget_curve(train, val, label="y", ranking=["a", "b", "c"], budgets=[1, 3, 2, 9, 0], penalty=0.01).collect()}
    assert sorted(got) == [1, 2, 3] and got[3].n_columns == 6 and {r.n_rows for r in got.values()} == {150}
    raw = np.array([[np.nan if v is None else v for v in r[1:4]] for r in found])
    y = np.array([r[4] for r in found])
    full = np.c_[raw, np.isnan(raw)][:, [0, 3, 1, 4, 2, 5]]
    full = np.where(np.isnan(full), np.nanmedian(full[:250], axis=0), full)
    for k in (1, 2, 3):
        w, scale = newton(full[:250, : 2 * k], y[:250], 0.01)
        p = 1 / (1 + np.exp(-np.c_[np.ones(150), full[250:, : 2 * k] / scale] @ w))
        truth = y[250:]
        loss = -np.mean(truth * np.log(p) + (1 - truth) * np.log(1 - p))
        auc = np.mean([(p[i] > p[j]) + 0.5 * (p[i] == p[j]) for i in np.flatnonzero(truth) for j in np.flatnonzero(1 - truth)])
        assert got[k].log_loss == pytest.approx(loss, abs=2e-3) and got[k].roc_auc == pytest.approx(auc, abs=2e-3)
    assert got[2].roc_auc > got[1].roc_auc + 0.02


def statistics(spark):
    rng = random.Random(9)
    found = []
    for base in ("one", "two", "three"):
        for _ in range(40):
            truth = int(rng.random() < 0.4)
            found.append((base, truth, truth * 0.5 + rng.random(), rng.random()))
    return spark.createDataFrame(found, "base string, truth int, r_del double, coverage double")


def test_calibrator_never_sees_the_group_it_scores(spark):
    d = statistics(spark)
    out = learn.calibrate_by_group(d, "truth", "base", ["r_del", "coverage"])
    assert out.count() == 120 and out.columns == [*d.columns, "probability", "penalty"]
    for r in metrics.binary_metrics(out, "truth", "probability", ["base"]).collect():
        assert r.roc_auc > 0.75
    penalty = out.first().penalty
    one = out.where("base = 'one'")
    # other labels in the scored group change nothing but the choice of the penalty
    turned = d.withColumn("truth", F.when(F.col("base") == "one", 1 - F.col("truth")).otherwise(F.col("truth")))
    again = learn.calibrate_by_group(turned, "truth", "base", ["r_del", "coverage"], penalties=[penalty])
    plain = learn.calibrate_by_group(d, "truth", "base", ["r_del", "coverage"], penalties=[penalty])
    assert rows(plain.where("base = 'one'").select("r_del", "probability"))[0][1] == pytest.approx(rows(one.select("r_del", "probability"))[0][1], abs=1e-6)
    rank = lambda df: [r[0] for r in df.where("base = 'one'").orderBy("probability").select("r_del").collect()]
    assert rank(again) == rank(plain)
    with pytest.raises(ValueError, match="another group"):
        learn.calibrate_by_group(d.where("base = 'one'"), "truth", "base", ["r_del"])


def test_reliability_counts_every_row(spark):
    d = spark.createDataFrame([(0.0, 0), (0.05, 1), (0.5, 1), (0.99, 1), (1.0, 1)], "p double, y int")
    got = {r.bin: (r.n_rows, round(r.mean_probability, 3), r.share_true) for r in learn.reliability(d, "y", "p").collect()}
    assert got == {0: (2, 0.025, 0.5), 5: (1, 0.5, 1.0), 9: (2, 0.995, 1.0)}


def test_learned_queries_beat_chance(spark):
    sf = "/root/testdata/sf0.01"
    by = {r.database: r for r in file_queries.calibrator_by_database(spark, sf).collect()}
    assert set(by) == {"customers", "suppliers", "orders"}
    assert all(r.roc_auc > 0.9 and r.brier < 0.5 for r in by.values())
    curve = {r.budget: r for r in file_queries.budget_curve(spark, sf).collect()}
    audit = {r.variant: r for r in file_queries.leakage_audit(spark, sf).collect()}
    assert audit["leaky"].low > 0.2 and abs(audit["dates"].delta_roc_auc) < 0.1
    assert set(curve) <= set(file_queries.BUDGETS) and curve[4].roc_auc > curve[1].roc_auc + 0.1


def test_leakage_audit_tells_the_leak(spark):
    rng = random.Random(2)
    found = []
    for k in range(800):
        a = rng.gauss(0, 1)
        y = int(a + rng.gauss(0, 1) > 0)
        found.append((k, y, a, rng.gauss(0, 1), y + rng.gauss(0, 0.3)))
    d = spark.createDataFrame(found, "id long, y int, safe double, noise double, future double")
    how = dict(label="y", row_key=["id"], variants={"safe": ["safe"], "noise": ["safe", "noise"], "leak": ["safe", "future"]}, replicates=30)
    out = {r.variant: r for r in learn.leakage_audit(d.where("id < 400"), d.where("id >= 400"), reference="safe", **how).collect()}
    assert {r.n_rows for r in out.values()} == {400} and out["leak"].n_features == 2
    assert out["safe"].delta_roc_auc == out["safe"].low == out["safe"].high == 0
    assert out["leak"].low > 0.05 and out["leak"].low < out["leak"].delta_roc_auc < out["leak"].high
    assert out["noise"].low < 0.02 and out["noise"].high > -0.02
    # the plain figures are those of the model's own scores
    scores = learn.score_matrix(d.where("id < 400"), d.where("id >= 400"), label="y", features=["safe"], row_key=["id"], task="logistic").collect()
    pairs = [(p.y_score > n.y_score) + 0.5 * (p.y_score == n.y_score) for p in scores if p.y_true == 1 for n in scores if n.y_true == 0]
    assert out["safe"].roc_auc == pytest.approx(sum(pairs) / len(pairs), abs=1e-9)
    with pytest.raises(ValueError, match="no variant"):
        learn.leakage_audit(d, d, reference="none", **how)


def test_fallback_proof_sees_any_change(spark):
    d = spark.createDataFrame([(k, None if k % 5 == 0 else k / 3, f"t{k % 3}", [k, None]) for k in range(60)], "k int, v double, t string, l array<int>")
    same = assemble.fallback_proof(d, d.orderBy(F.rand(3)).select("t", "l", "v", "k"), ["k"])
    assert rows(same) == [(c, True, True, True) for c in sorted("kvtl")]
    swapped = d.withColumn("v", F.when(F.col("k") == 1, 2 / 3).when(F.col("k") == 2, 1 / 3).otherwise(F.col("v")))
    filled = d.withColumn("v", F.coalesce("v", F.lit(0.0)))
    fewer = d.where("k <> 7")
    assert {r["column"] for r in assemble.fallback_proof(d, swapped, ["k"]).collect() if not r.same} == {"v"}
    assert {r["column"] for r in assemble.fallback_proof(d, filled, ["k"]).collect() if not r.same} == {"v"}
    assert not any(r.same for r in assemble.fallback_proof(d, fewer, ["k"]).collect())
    extra = {r["column"]: (r.in_baseline, r.in_chosen, r.same) for r in assemble.fallback_proof(d, d.drop("t").withColumn("n", F.lit(1)), ["k"]).collect()}
    assert extra["t"] == (True, False, False) and extra["n"] == (False, True, False)


def candidates(spark, mirrored=()):
    """Three databases whose true programs stand out by ``signal``; in a mirrored one they stand out downwards."""
    rng = random.Random(12)
    found = []
    for base in ("one", "two", "three"):
        for k in range(30):
            known = int(k < 3)
            signal = known * 4 + rng.random()
            found.append((base, f"p{k}", known, -signal if base in mirrored else signal, None if k % 7 == 6 else rng.random() * 1000))
    return spark.createDataFrame(found, "base string, name string, known int, signal double, noise double")


HELD_OUT = {"group": "base", "item": "name", "label": "known", "features": ["signal", "noise"]}


def test_held_out_ranker_finds_what_other_databases_teach(spark):
    d = candidates(spark)
    out = learn.rank_held_out(d, **HELD_OUT).collect()
    assert len(out) == 90 and {(r.base, r["rank"]) for r in out} == {(b, k) for b in ("one", "two", "three") for k in range(1, 31)}
    assert all(r["rank"] <= 3 for r in out if r.known == 1)


def test_held_out_ranker_sees_no_label_of_its_group(spark):
    d = candidates(spark)
    turned = d.withColumn("known", F.when(F.col("base") == "two", 1 - F.col("known")).otherwise(F.col("known")))
    scores = lambda x: {r.name: r.ranker_score for r in learn.rank_held_out(x, **HELD_OUT).where("base = 'two'").collect()}
    assert scores(d) == scores(turned)
    others = lambda x: {(r.base, r.name): r.ranker_score for r in learn.rank_held_out(x, **HELD_OUT).where("base != 'two'").collect()}
    assert others(d) != others(turned)
    # what is learned is the direction in the others, right or wrong for the one left out
    wrong = learn.rank_held_out(candidates(spark, mirrored=("two",)), **HELD_OUT).where("base = 'two' AND known = 1").collect()
    assert all(r["rank"] > 27 for r in wrong)


def test_ranking_pairs_grow_with_candidates_and_weigh_one_a_group(spark):
    d = candidates(spark).unionByName(spark.createDataFrame([("only", "a", 1, 1.0, 1.0), ("only", "b", 1, 2.0, 1.0), ("one", "n", None, 9.0, 9.0)], candidates(spark).schema))
    pairs = learn.ranking_pairs(d, opponents=2, **HELD_OUT)
    got = {r.base: (r.n, r.w, r.up) for r in pairs.groupBy("base").agg(F.count("*").alias("n"), F.sum("weight").alias("w"), F.sum("y").alias("up")).collect()}
    assert set(got) == {"one", "two", "three"}
    for n, w, up in got.values():
        assert n == 3 * 2 + 27 * 2 and up == 6 and w == pytest.approx(1)
    assert pairs.where("y = 1 AND d_0 < 2").count() == 0 and pairs.where("y = 0 AND d_0 > -2").count() == 0


def test_held_out_ranker_needs_another_group(spark):
    with pytest.raises(ValueError):
        learn.rank_held_out(candidates(spark).where("base = 'one'"), **HELD_OUT)
    with pytest.raises(ValueError):
        learn.rank_held_out(candidates(spark).withColumn("known", F.lit(1)), **HELD_OUT)


def test_ranker_of_other_databases_beats_the_heuristic(spark):
    got = run_queries.program_ranker_held_out(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 15 and {r.k for r in got} == {1, 2, 4}
    mean = lambda c, k: sum(r[c] for r in got if r.k == k) / 5
    assert mean("recall", 2) >= 0.8 and all(mean("recall", k) > mean("heuristic_recall", k) for k in (1, 2, 4))
