import json

import pytest
from pyspark.sql import functions as F

from tidemark.__main__ import main
from tidemark.operators import assemble, learn, prepare
from tidemark.plans import compile_task, task_queries
from tidemark.sources import tables

SF = "/root/testdata/sf0.001"


def test_task_end_to_end(spark):
    targets, data = task_queries._inputs(spark, SF)
    chosen, decision, runs, edges = compile_task.run_task(spark, task_queries.SPEC, targets, data, seeds=(41, 42))
    assert edges == [("n_name", "r_name")]
    assert runs.count() == 4
    has_amb = any(c.startswith("f_amb__") for c in chosen["val"].columns)
    assert has_amb == (decision["outcome"] == "SELECT")
    assert chosen["train"].columns == chosen["val"].columns
    assert chosen["val"].count() == targets["val"].count()


def test_no_edge_falls_back_exactly(spark):
    targets, data = task_queries._inputs(spark, SF)
    spec = compile_task.TaskSpec(**{**task_queries.SPEC.__dict__, "thresholds": {"min_r_del": 1.01}})
    base, cand, edges = compile_task.compile_matrices(spec, targets, data)
    assert edges == [] and cand is base


def test_label_is_never_a_dependency_column(spark):
    targets, data = task_queries._inputs(spark, SF)
    data["customer_geo"] = data["customer_geo"].withColumn("is_open", F.col("n_name"))
    spec = compile_task.TaskSpec(**{**task_queries.SPEC.__dict__, "dependency_columns": ["n_name", "r_name", "is_open"], "max_edges": 5})
    _, edges = compile_task.chosen_edges(spec, targets["train"], data)
    assert ("n_name", "r_name") in edges and all("is_open" not in e for e in edges)


def test_command_line(spark, tmp_path, capsys):
    targets, data = task_queries._inputs(spark, SF)
    for n in ("orders", "customer_geo"):
        tables.write_table(data[n], f"{tmp_path}/table_{n}.parquet")
    for s, t in targets.items():
        tables.write_table(t, f"{tmp_path}/target_{s}.parquet")
    spec = {**task_queries.SPEC.__dict__, "dependency_columns": []}
    (tmp_path / "spec.json").write_text(json.dumps(spec))
    main(["run", str(tmp_path / "spec.json"), str(tmp_path), str(tmp_path / "out")])
    assert "FALLBACK" in capsys.readouterr().out
    assert spark.read.parquet(f"{tmp_path}/out/matrix_val.parquet").count() == targets["val"].count()
    main(["inspect", str(tmp_path), "orders"])
    assert "orders" in capsys.readouterr().out


@pytest.mark.parametrize("task", ["logistic", "multiclass", "regression"])
def test_decoder_seam(spark, task):
    d = spark.range(200).select("id", (F.col("id") % 7).cast("double").alias("x"), F.lit(1.0).alias("flat"), (F.col("id") % 7 > 3).cast("int").alias("y"))
    out = learn.score_matrix(d.where("id < 150"), d.where("id >= 150"), label="y", features=["x", "flat"], row_key=["id"], task=task)
    assert out.count() == 50 and {"id", "y_true", "y_score"} <= set(out.columns)


def test_blocks_gate_modes_and_outputs(spark, tmp_path, capsys):
    targets, data = task_queries._inputs(spark, SF)
    orders = data["orders"]
    data["orders"] = orders.withColumn("is_late", F.col("o_orderkey") % 2 == 0)
    targets = {s: t.withColumn("lane", F.concat(F.lit("l"), F.col("o_orderkey") % 3)) for s, t in targets.items()}
    last = {"operator": "latest_value", "tables": ["orders"], "args": {
        "keys": ["o_custkey"], "target_time": "o_orderdate", "child_keys": ["o_custkey"], "child_time": "o_orderdate", "value": "o_totalprice", "prefix": "price", "cutoff": "strict"}}
    spec = compile_task.TaskSpec(**{**task_queries.SPEC.__dict__, "blocks": [last], "gate_mode": "lexicographic", "gate_metrics": ["accuracy", "roc_auc"]})
    base, _, _ = compile_task.compile_matrices(spec, targets, data)
    assert "price_latest" in base["val"].columns and "lane" in compile_task.feature_columns(spec, base["train"])
    ready = compile_task.scoring_matrices(spec, base)
    assert dict(ready["val"].dtypes)["lane"] == "bigint" and ready["val"].select("lane").distinct().count() == 3
    runs = spark.createDataFrame(
        [("t", v, s, a, r) for s in (1, 2) for v, a, r in (("baseline", 0.5, 0.6), ("candidate", 0.5, 0.7))], "task string, variant string, seed bigint, accuracy double, roc_auc double")
    assert compile_task.decide(spec, runs).first()["outcome"] == "SELECT"
    compile_task.require_all_seeds(runs, [1, 2])
    with pytest.raises(ValueError, match="seeds of"):
        compile_task.require_all_seeds(runs, [1, 2, 3])


def test_repeated_key_in_a_block_is_an_error(spark):
    base, twice = spark.range(3), spark.createDataFrame([(1, 2.0), (1, 3.0)], "id long, f double")
    with pytest.raises(Exception, match="repeated row key"):
        assemble.assemble_blocks(base, [twice], ["id"]).collect()
    assert assemble.assemble_blocks(base, [twice.limit(1)], ["id"]).count() == 3


def test_unseen_classes_only_is_an_error(spark):
    train, val = spark.createDataFrame([("1e3",), ("a",)], "y string"), spark.createDataFrame([("1000",)], "y string")
    with pytest.raises(ValueError, match="no validation row"):
        prepare.require_seen_classes(train, val, "y")  # with text in the column, 1e3 is not 1000
    assert prepare.require_seen_classes(train.limit(1), val, "y").count() == 1
