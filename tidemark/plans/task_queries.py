"""A whole task compiled on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import assemble
from tidemark.plans import compile_task
from tidemark.plans.data import customer_geo, load, round_to
from tidemark.plans.dependency_queries import ORACLES as DEP
from tidemark.plans.temporal_queries import ORACLES as TIME

SPEC = compile_task.TaskSpec(
    name="order-status", row_key=["o_orderkey"], target_key="o_custkey", target_time="o_orderdate", label="is_open",
    child_table="orders", child_key="o_custkey", child_time="o_orderdate", value="o_totalprice", prefix="hist", cutoff="strict",
    entity_table="customer_geo", entity_key="c_custkey", dependency_columns=["c_mktsegment", "n_name", "r_name"],
)


def _inputs(spark, sf):
    orders = load(spark, sf, "orders")
    target = orders.select("o_orderkey", "o_custkey", "o_orderdate", (F.col("o_orderstatus") == "O").cast("int").alias("is_open"))
    early = F.col("o_orderdate") < F.expr("timestamp_ntz'1998-01-01 00:00:00'")
    tables = {"orders": orders, "customer_geo": customer_geo(spark, sf)}
    return {"train": target.where(early), "val": target.where(~early)}, tables


def compiled_matrix(spark, sf):
    """Validation matrix with history and ambiguity features; the edge is found on training rows."""
    targets, tables = _inputs(spark, sf)
    _, candidate, _ = compile_task.compile_matrices(SPEC, targets, tables)
    digits = {"hist_mean": 4, "hist_std": 3}
    m = candidate["val"]
    return m.select(*[round_to(c, digits.get(c, 6)).alias(c) if k == "double" and c != "hist_max" else F.col(c) for c, k in m.dtypes])


def compiled_manifest(spark, sf):
    """Every feature of the compiled matrix with its block and temporal rule."""
    targets, tables = _inputs(spark, sf)
    _, candidate, _ = compile_task.compile_matrices(SPEC, targets, tables)
    names = [c for c in candidate["val"].columns if c.startswith(("hist_", "f_amb__"))]
    rows = [(c, "ambiguity" if c.startswith("f_amb__") else "aggregation", "fit on train" if c.startswith("f_amb__") else "child < cutoff") for c in names]
    rows.append(("hist_median", "aggregation", "child < cutoff"))
    programs = spark.createDataFrame(rows, "feature string, block string, temporal string")
    sizes = candidate["val"].agg(*[F.count(c).alias(c) for c in names]).unpivot([], names, "feature", "n_present")
    return assemble.feature_manifest(candidate["val"], programs).join(F.broadcast(sizes), "feature", "left")


MATRIX_SQL = f"""
SELECT o.o_orderkey, o.o_custkey, o.o_orderdate, (o_orderstatus = 'O')::INT AS is_open, p.* EXCLUDE (o_orderkey), a.* EXCLUDE (o_orderkey)
FROM orders o JOIN ({TIME['pit_order_history']}) p ON p.o_orderkey = o.o_orderkey JOIN ({DEP['ambiguity_features_orders']}) a ON a.o_orderkey = o.o_orderkey
WHERE o_orderdate >= TIMESTAMP '1998-01-01'"""
_HIST = [f"hist_{k}" for k in ("count", "mean", "std", "max", "days_since_last")]
_AMB = [f"f_amb__n_name_to_r_name__{k}" for k in ("majconf", "entropy", "conflict_count", "support_count")]

QUERIES = {"compiled_matrix": compiled_matrix, "compiled_manifest": compiled_manifest}
ORACLES = {
    "compiled_matrix": MATRIX_SQL,
    "compiled_manifest": f"WITH m AS ({MATRIX_SQL}) " + " UNION ALL ".join(
        f"SELECT '{c}{s}' AS feature, '{b}' AS block, '{t}' AS temporal, TRUE AS materialised, count(\"{c}{s}\") AS n_present FROM m"
        for cols, b, t in ((_HIST, "aggregation", "child < cutoff"), (_AMB, "ambiguity", "fit on train")) for c in cols for s in ("", "__is_missing")
    ) + " UNION ALL SELECT 'hist_median', 'aggregation', 'child < cutoff', FALSE, NULL",
}
