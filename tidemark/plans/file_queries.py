"""Sources and sinks bound to files that Spark writes from the driver tables to the shared folder and reads again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import dependency as dep
from tidemark.operators import assemble, learn, metrics, rank, temporal
from tidemark.plans.data import customer_geo, load, orders_history, rounded
from tidemark.plans.dependency_queries import GEO_COLS
from tidemark.plans.metric_queries import DOC_FEATURES, labelled_once
from tidemark.session import ensure_checkpoint_dir
from tidemark.sources import publish, run_files

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("published_orders", """
SELECT o_orderstatus, count(*) AS n_rows, round(sum(o_totalprice), 2) AS total, count(DISTINCT o_custkey) AS n_customers,
  (SELECT count(*) FROM orders)::BIGINT AS manifest_rows, true AS files_same FROM orders GROUP BY 1""")
def published_orders(spark, sf):
    """Orders published by status; figures come from the published files, totals from the manifest."""
    o, folder = load(spark, sf, "orders"), _folder(spark, "orders")
    manifest = publish.publish(o, folder, partition_by=["o_orderstatus"])
    same = publish.verify(spark, folder, o).agg(F.bool_and(F.col("state") == "same")).scalar()
    rows = manifest.agg(F.sum("n_rows")).scalar()
    back = publish.read_published(spark, folder, o)
    return back.groupBy("o_orderstatus").agg(
        F.count("*").alias("n_rows"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.count_distinct("o_custkey").alias("n_customers")
    ).select("*", rows.alias("manifest_rows"), same.alias("files_same"))


def _sessions(spark, sf):
    """One run per forty-first part of the users and kind of event, as a result file would report it."""
    e = load(spark, sf, "events").withColumn("user_id", F.col("user_id") % 41).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("top"))
    return e


SESSION_SQL = "SELECT user_id % 41 AS user_id, event_type, count(*) n, avg(value) mean, max(value) top FROM events GROUP BY 1, 2"


@query("json_results_read", f"""
SELECT CASE WHEN user_id % 3 = 0 THEN 'own-' || event_type ELSE 'rel-' || event_type END AS dataset, 'user-' || event_type AS task, user_id AS seed,
  'v' || (user_id % 2) AS variant, NULL::DOUBLE AS accuracy, round(CASE WHEN user_id % 2 = 0 THEN mean END, 6) AS roc_auc, round(CASE WHEN user_id % 2 = 1 THEN mean END, 6) AS average_precision,
  round(top, 6) AS log_loss, n::DOUBLE AS runtime_sec FROM ({SESSION_SQL})""")
def json_results_read(spark, sf):
    """A JSON file per run under a path that names data set, task and seed; some files name their data set themselves, nested metrics have several names."""
    s = _sessions(spark, sf)
    even = F.col("user_id") % 2 == 0
    result = F.struct(
        F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("own-"), "event_type")).alias("dataset"), F.concat(F.lit("v"), (F.col("user_id") % 2).cast("string")).alias("variant"),
        F.struct(F.struct(F.when(even, F.col("mean")).alias("auroc"), F.when(~even, F.col("mean")).alias("ap")).alias("val"), F.col("top").alias("loss")).alias("metrics"),
        F.col("n").alias("runtime_seconds"),
    )
    folder = _folder(spark, "results")
    named = s.select(F.concat(F.lit("rel-"), "event_type", F.lit("_user-"), "event_type").alias("set"), F.concat(F.lit("seed_"), F.col("user_id").cast("string")).alias("run"), F.to_json(result).alias("value"))
    named.repartition("set", "run").write.partitionBy("set", "run").text(folder)
    found = run_files.read_json_results(spark, f"{folder}/*/*")
    return rounded(found.drop("result_path"))


@query("timing_logs_read", """
SELECT user_id % 41 AS user_id, (3600 * (any_value(user_id) % 41 % 3) + count(*) + 0.5)::DOUBLE AS elapsed_wall_time_sec, count(*)::DOUBLE AS user_time_sec, 0.25::DOUBLE AS system_time_sec,
  (count(*) + 1)::DOUBLE AS peak_memory_mb FROM events GROUP BY 1""")
def timing_logs_read(spark, sf):
    """A report file per part of the users, read whole; the part is read off the path."""
    e = load(spark, sf, "events").groupBy((F.col("user_id") % 41).alias("user_id")).agg(F.count("*").alias("n"))
    clock = F.when(F.col("user_id") % 3 == 0, F.format_string("%d:%05.2f", (F.col("n") / 60).cast("int"), F.col("n") % 60 + 0.5)).otherwise(
        F.format_string("%d:%02d:%05.2f", F.col("user_id") % 3, (F.col("n") / 60).cast("int"), F.col("n") % 60 + 0.5)
    )
    log = F.concat(
        F.lit("\tUser time (seconds): "), F.format_string("%.2f", F.col("n").cast("double")), F.lit("\n\tSystem time (seconds): 0.25\n\tElapsed (wall clock) time (h:mm:ss or m:ss): "), clock,
        F.lit("\n\tMaximum resident set size (kbytes): "), ((F.col("n") + 1) * 1024).cast("string"), F.lit("\n"),
    )
    folder = _folder(spark, "logs")
    e.select(F.col("user_id").alias("user"), log.alias("value")).repartition("user").write.partitionBy("user").text(folder)
    out = run_files.read_timing_logs(spark, f"{folder}/*")
    return out.select(F.regexp_extract("log_path", "user=([0-9]+)", 1).cast("bigint").alias("user_id"), *[c for c in out.columns if c not in ("log_path", "user")])


@query("csv_tables_read", """
SELECT c_mktsegment, c_custkey, CASE WHEN c_custkey % 2 = 0 THEN round(c_acctbal, 2) END AS c_acctbal, CASE WHEN c_custkey % 2 = 1 THEN c_name END AS c_name FROM customer""")
def csv_tables_read(spark, sf):
    """Two CSV tables that share some columns, and one that is missing, as one table."""
    c = load(spark, sf, "customer").withColumn("c_acctbal", F.round("c_acctbal", 2))
    folder = _folder(spark, "csv")
    c.where("c_custkey % 2 = 0").select("c_custkey", "c_mktsegment", "c_acctbal").write.csv(f"{folder}/even", header=True)
    c.where("c_custkey % 2 = 1").select("c_name", "c_mktsegment", "c_custkey").write.csv(f"{folder}/odd", header=True)
    found = run_files.read_csv_tables(spark, [f"{folder}/even", f"{folder}/gone", f"{folder}/odd"])
    return found.select("c_mktsegment", F.col("c_custkey").cast("bigint").alias("c_custkey"), F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_name")


@query("fallback_proof", """
SELECT * FROM (VALUES ('FALLBACK', 'o_orderkey', true, true, true), ('FALLBACK', 'o_custkey', true, true, true), ('FALLBACK', 'o_totalprice', true, true, true),
  ('SELECT', 'o_orderkey', true, true, true), ('SELECT', 'o_custkey', true, true, (SELECT count(*) FILTER (o_orderkey % 97 = 0 AND o_custkey IS NOT NULL) = 0 FROM orders)),
  ('SELECT', 'o_totalprice', true, true, true), ('SELECT', 'f_month', false, true, false)) t(outcome, "column", in_baseline, in_chosen, same)""")
def fallback_proof(spark, sf):
    """A matrix read back in another order after a fallback, and a candidate with a new column and one altered value in 97."""
    base = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    candidate = load(spark, sf, "orders").select(
        "o_totalprice", F.when(F.col("o_orderkey") % 97 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("o_custkey"), "o_orderkey", F.month("o_orderdate").alias("f_month")
    )
    out = None
    for outcome in ("FALLBACK", "SELECT"):
        chosen = assemble.apply_decision(outcome, base.repartition(5, "o_custkey").select("o_totalprice", "o_orderkey", "o_custkey"), candidate)
        rows = assemble.fallback_proof(base, chosen, ["o_orderkey"]).select(F.lit(outcome).alias("outcome"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


BUDGETS = [1, 2, 4, 8]


@query("budget_curve")
def budget_curve(spark, sf):
    """Document features ranked on one half of the labels; models of growing prefixes scored on the other half."""
    d = labelled_once(spark, sf)
    train, val = d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1")
    order = rank.rank_supervised(rank.supervised_scores(train, DOC_FEATURES, "quality"), "auc", len(DOC_FEATURES))
    names = [r["feature"] for r in order.orderBy("rank").select("feature").collect()]  # one row per feature
    return rounded(learn.budget_curve(train, val, label="quality", ranking=names, budgets=BUDGETS), 4)


def _dependencies(spark, sf):
    """Calibration statistics of three databases, with the dependencies that their schemas imply."""
    n, r = load(spark, sf, "nation"), load(spark, sf, "region")
    s = load(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, n.n_regionkey == r.r_regionkey)
    s = s.select("s_suppkey", "s_nationkey", F.col("n_name").alias("s_nation"), F.col("r_name").alias("s_region"), F.floor(F.col("s_acctbal") * 100 % 100).alias("s_cents"))
    o = load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select("o_orderkey", "o_custkey", "c_nationkey", "c_mktsegment", "o_orderstatus", "o_orderpriority")
    sides = [
        ("customers", customer_geo(spark, sf), GEO_COLS, "c_custkey", [(a, b) for a in ("c_custkey", "n_name") for b in ("n_name", "r_name", "n_regionkey") if a != b] + [("n_regionkey", "r_name"), ("r_name", "n_regionkey"), ("c_custkey", "c_mktsegment")]),
        ("suppliers", s, ["s_nationkey", "s_nation", "s_region", "s_cents"], "s_suppkey", [("s_nationkey", "s_nation"), ("s_nation", "s_nationkey"), ("s_nationkey", "s_region"), ("s_nation", "s_region")]),
        ("orders", o, ["o_custkey", "c_nationkey", "c_mktsegment", "o_orderstatus", "o_orderpriority"], "o_orderkey", [("o_custkey", "c_nationkey"), ("o_custkey", "c_mktsegment")]),
    ]
    out = None
    for name, df, columns, key, right in sides:
        known = F.concat_ws(">", "lhs", "rhs").isin([f"{a}>{b}" for a, b in right])
        rows = dep.calibration_statistics(df, columns, row_key=[key], replicates=4).select(F.lit(name).alias("database"), "*", F.lit(0).alias("schema_flag"), known.cast("int").alias("truth"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("calibrator_by_database")
def calibrator_by_database(spark, sf):
    """Each database's dependencies, judged by a model of the other two: ranking quality and Brier score."""
    scored = learn.calibrate_by_group(_dependencies(spark, sf), "truth", "database")
    brier = scored.groupBy("database").agg(F.avg(F.pow(F.col("probability") - F.col("truth"), 2)).alias("brier"), F.sum("truth").alias("n_true"))
    found = metrics.binary_metrics(scored, "truth", "probability", ["database"]).select("database", "n_rows", "roc_auc", "average_precision")
    return rounded(found.join(brier, "database"), 4)


@query("leakage_audit")
def leakage_audit(spark, sf):
    """Whether an order is a large one, from its date, from its customer's past, and from a past that lets the order itself in."""
    o = orders_history(spark, sf)
    args = dict(row_key=["o_orderkey"], keys=["o_custkey"], target_time="o_orderdate", child_keys=["o_custkey"], child_time="o_orderdate", value="o_totalprice")
    parts = [temporal.latest_value(o, o, prefix=name, cutoff=cutoff, **args) for name, cutoff in (("strict", "strict"), ("loose", "inclusive"))]
    base = o.select("o_orderkey", (F.col("o_totalprice") > 250_000).cast("int").alias("large"), F.month("o_orderdate").alias("month"), F.dayofweek("o_orderdate").alias("weekday"))
    folder = _folder(spark, "audit")  # each model reads the matrix several times
    assemble.assemble_blocks(base, parts, ["o_orderkey"]).write.parquet(folder)
    d = spark.read.parquet(folder)
    dates, past, leak = ["month", "weekday"], ["strict_latest", "strict_days_since_latest"], ["loose_latest"]
    found = learn.leakage_audit(
        d.where("o_orderkey % 2 = 0"), d.where("o_orderkey % 2 = 1"), label="large", row_key=["o_orderkey"], reference="safe",
        variants={"dates": dates, "safe": dates + past, "leaky": dates + past + leak},
    )
    return rounded(found, 4)
