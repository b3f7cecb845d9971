"""Plans whose rows must not grow with the number of bootstrap replicates."""

import re

from pyspark.sql import functions as F

from tidemark.operators import dependency, learn, scan
from tidemark.plans import metric_queries, run_queries, temporal_queries


def test_audit_shuffles_no_row_per_replicate(spark, capsys):
    d = spark.range(600).select("id", (F.col("id") * 7919 % 601).alias("x"), (F.col("id") * 31 % 97).alias("z"))
    d = d.withColumn("y", ((F.col("x") + F.col("z") * 3) > 430).cast("int"))
    out = learn.leakage_audit(
        d.where("id < 300"), d.where("id >= 300"), label="y", row_key=["id"], reference="a", variants={"a": ["z"], "b": ["z", "x"]}, replicates=3
    )
    found = {r.variant: r for r in out.collect()}
    assert found["a"].n_rows == found["b"].n_rows == 300
    assert found["b"].delta_roc_auc > 0 and found["b"].low <= found["b"].delta_roc_auc <= found["b"].high
    out.explain()
    assert not re.search(r"hashpartitioning\(variant#\d+, replicate#\d+, __s#", capsys.readouterr().out)


def test_pair_statistics_size_their_shuffles(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(dependency, "deal_shuffles", lambda _, rows: asked.append(rows))
    dependency.pair_statistics(spark.range(50).select("id", (F.col("id") % 7).alias("a"), (F.col("id") % 3).alias("b")), ["id", "a", "b"])
    assert asked == [150]


def test_dealt_shuffles_are_not_merged_to_millions_of_rows(spark):
    merged = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(merged)
    try:
        spark.conf.set(merged, "64MB")
        scan.deal_shuffles(spark, scan.SHUFFLE_ROWS)
        assert spark.conf.get(merged) == "64MB"
        scan.deal_shuffles(spark, 20 * scan.SHUFFLE_ROWS)
        assert scan._bytes(spark.conf.get(merged)) == 8 << 20
        spark.conf.set(merged, "4m")
        scan.deal_shuffles(spark, 20 * scan.SHUFFLE_ROWS)
        assert spark.conf.get(merged) == "4m"
    finally:
        spark.conf.set(merged, before)


def test_look_backs_deal_every_probe(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(scan, "deal_shuffles", lambda _, rows: asked.append(rows))
    temporal_queries.lookback_events(spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert asked == [6 * n]  # events and targets, each target asked at three instants at most


def test_brands_are_dealt_before_anything_is_joined(spark, monkeypatch):
    asked, joined = [], []
    monkeypatch.setattr(temporal_queries, "deal_shuffles", lambda _, rows: asked.append(rows))
    monkeypatch.setattr(scan, "deal_shuffles", lambda *_: None)
    real = scan.measure_groups
    monkeypatch.setattr(scan, "measure_groups", lambda *sides, **k: joined.append(sides) or real(*sides, **k))
    temporal_queries.category_state_brands(spark, "/root/testdata/sf0.001")
    count = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").count()
    assert asked == [2 * (count("orders") + count("lineitem"))]
    assert not joined  # no measure of the joined lines by the operator


def test_models_do_not_read_the_texts_again(spark, monkeypatch):
    """Neither a fit nor the scores come from documents once the matrix is written."""
    real = metric_queries.labelled
    monkeypatch.setattr(metric_queries, "labelled", lambda *a: real(*a).limit(200))
    given = []
    monkeypatch.setattr(run_queries.learn, "score_matrix", lambda a, b, **_: given.extend([a, b]) or b.selectExpr("doc_id", "0.0D AS y_true", "0.5D AS y_score"))
    run_queries.decoder_scores(spark, "/root/testdata/sf0.001")
    assert len(given) == 4 and not any("documents.parquet" in f for d in given for f in d.inputFiles())


def test_dealt_rows_hold_numbers_of_narrow_columns(spark, monkeypatch, capsys):
    """Lines dealt by a wide column carry no code of every column, and both uses of their counts read one shuffle."""
    monkeypatch.setattr(dependency, "WIDE_VALUES", 60)
    monkeypatch.setattr(dependency, "LIGHT_CELLS", 100)
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    dependency.pair_statistics(lines, ["l_partkey", "l_orderkey", "l_quantity", "l_tax", "l_returnflag", "l_linenumber"]).explain()
    plan = capsys.readouterr().out
    sent = [m.splitlines()[1] for m in re.findall(r"hashpartitioning\(l#\d+, x#\d+L?,.*\n.*", plan) if "REPARTITION" in m]
    assert len(sent) == 2 and not any(re.search(r", c#\d+[,\]]", line) for line in sent)
    assert [re.findall(r" AS (\w+)#", line) for line in sent] == [["l", "x", "__w0", "__p0"]] * 2  # the other wide column, all narrow ones
