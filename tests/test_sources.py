import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.sources import run_files, tables


def test_json_results(spark, tmp_path):
    d = tmp_path / "rel-shop_item-churn" / "seed_43"
    d.mkdir(parents=True)
    (d / "a.json").write_text(json.dumps({"variant": "dfs", "metrics": {"auroc": 0.7, "acc": 0.6}, "runtime_seconds": 3}))
    e = tmp_path / "other"
    e.mkdir()
    (e / "b.json").write_text(json.dumps({"dataset": "x", "task": "y", "seed": 7, "variant": "v", "ap": "0.5", "metrics": {"log_loss": 0.2}}))
    out = run_files.read_json_results(spark, [str(d / "a.json"), str(e / "b.json")])
    got = rows(out.select("dataset", "task", "seed", "variant", "accuracy", "roc_auc", "average_precision", "log_loss", "runtime_sec"))
    assert got == [
        ("rel-shop", "item-churn", 43, "dfs", 0.6, 0.7, None, None, 3.0),
        ("x", "y", 7, "v", None, None, 0.5, 0.2, None),
    ]


def test_csv_union_skips_missing_and_empty(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("x,z\n3,4\n")
    (tmp_path / "c.csv").write_text("")
    paths = [str(tmp_path / n) for n in ("a.csv", "b.csv", "c.csv", "absent.csv")]
    out = run_files.read_csv_tables(spark, paths)
    assert rows(out.select("x", "y", "z")) == [("1", "2", None), ("3", None, "4")]
    with pytest.raises(ValueError, match="no readable"):
        run_files.read_csv_tables(spark, paths[2:])


def test_timing_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text(
        "\tUser time (seconds): 12.5\n\tSystem time (seconds): 1.5\n"
        "\tElapsed (wall clock) time (h:mm:ss or m:ss): 1:02:03\n\tMaximum resident set size (kbytes): 2048\n"
    )
    (tmp_path / "b.log").write_text("Elapsed (wall clock) time (h:mm:ss or m:ss): 0:23.75\n")
    (tmp_path / "c.log").write_text("[TIME_WRAPPER] start_unix: 100\nx\n[TIME_WRAPPER] end_unix: 142\n")
    got = rows(run_files.read_timing_logs(spark, str(tmp_path)).drop("log_path"))
    assert got == [(23.75, None, None, None), (42.0, None, None, None), (3723.0, 12.5, 1.5, 2.0)]


def test_bundle_round_trip(spark, tmp_path):
    df = spark.range(5).withColumn("v", F.col("id") * 2)
    tables.write_table(df, f"{tmp_path}/table_a.parquet")
    tables.write_table(df.limit(2), f"{tmp_path}/target_train.parquet")
    assert (tmp_path / "table_a.parquet" / "_SUCCESS").exists()
    b = tables.read_bundle(spark, str(tmp_path), ["a"], ["train"])
    assert rows(tables.bundle_profile(b)) == [("a", 5, 2, "id,v"), ("target_train", 2, 2, "id,v")]
    tables.register_views(b)
    assert spark.sql("select sum(v) from a").first()[0] == 20
    tables.write_csv(df, f"{tmp_path}/m")
    assert spark.read.csv(f"{tmp_path}/m", header=True).count() == 5
    assert tables.read_table(spark, f"{tmp_path}/table_a.parquet", ["v"]).columns == ["v"]
