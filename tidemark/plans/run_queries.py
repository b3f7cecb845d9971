"""Run tables and gates built from metrics on the driver tables, with DuckDB oracles.

Runs are real: two label tasks, four score variants, four seeds (each mixes a tenth of its own hash noise into
the scores), all labelled documents, scored with the library's metrics.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import dependency as dep
from tidemark.operators import gate, learn, metrics, rank, runs
from tidemark.plans.data import customer_geo, load, round_to, rounded
from tidemark.plans.dependency_queries import GEO_COLS
from tidemark.plans.metric_queries import DOC_FEATURES, DOC_SQL, doc_features, labelled, labelled_once
from tidemark.session import ensure_checkpoint_dir
from tidemark.sources import run_files

QUERIES = {}
ORACLES = {}
TASK = ["dataset", "task"]
SEEDS = [41, 42, 43, 44]
METRICS = ["accuracy", "roc_auc", "average_precision", "log_loss"]
WIDTH = {"target_only": 1, "dfs": 3, "compiled": 5, "compiled_plus": 8}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def run_rows(spark, sf):
    """(task, variant, seed, y, s) score rows."""
    d = labelled(spark, sf)
    dfs = 1 / (1 + F.exp(-(F.col("digit_share") * 20.0 - 1.0)))
    comp = F.col("n_words").cast("double") / (F.col("n_words") + 200)
    scores = {"target_only": F.lit(0.5), "dfs": dfs, "compiled": comp, "compiled_plus": 0.5 * dfs + 0.5 * comp}
    mixed = lambda v, e: e if v == "target_only" else 0.9 * e + 0.1 * F.col("noise")
    variants = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), mixed(v, e).alias("s")) for v, e in scores.items()]))
    tasks = F.explode(F.array(*[F.struct(F.lit(t).alias("task"), F.col(t).alias("y")) for t in ("quality", "toxic")]))
    out = d.select("*", F.explode(F.array(*[F.lit(s) for s in SEEDS])).alias("seed"))
    h = F.conv(F.substring(F.md5(F.concat_ws("~", F.col("doc_id").cast("string"), F.col("seed").cast("string"))), 1, 8), 16, 10).cast("bigint")
    out = out.withColumn("noise", ((h % 1000).cast("double") + 0.5) / 1000)
    out = out.select("*", variants.alias("v")).select("*", tasks.alias("t"))
    return out.select(F.lit("docs").alias("dataset"), "t.task", "v.variant", "seed", "t.y", "v.s")


def run_table(spark, sf):
    m = metrics.binary_metrics(run_rows(spark, sf), "y", "s", [*TASK, "variant", "seed"])
    width = F.create_map(*[x for k, v in WIDTH.items() for x in (F.lit(k), F.lit(v).cast("bigint"))])
    return m.select(
        *TASK, "variant", F.col("seed").cast("bigint").alias("seed"), F.col("n_rows").alias("n_val"),
        *[round_to(c, 9).alias(c) for c in METRICS], F.element_at(width, F.col("variant")).alias("n_features"),
    )


RUNS_SQL = f"""{DOC_SQL},
sd AS (SELECT doc.*, quality, toxic, seed, ((('0x' || substr(md5(doc_id::VARCHAR || '~' || seed::VARCHAR), 1, 8))::BIGINT % 1000)::DOUBLE + 0.5::DOUBLE) / 1000::DOUBLE u
  FROM doc JOIN labels USING (doc_id), (VALUES (41), (42), (43), (44)) t(seed)),
sv AS (SELECT *, 1 / (1 + exp(-(digit_share * 20.0 - 1.0))) d, n_words::DOUBLE / (n_words + 200) c FROM sd),
sr AS (
  SELECT seed, quality, toxic, 'target_only' AS variant, 0.5::DOUBLE s, 1 w FROM sv UNION ALL SELECT seed, quality, toxic, 'dfs', 0.9::DOUBLE * d + 0.1::DOUBLE * u, 3 FROM sv
  UNION ALL SELECT seed, quality, toxic, 'compiled', 0.9::DOUBLE * c + 0.1::DOUBLE * u, 5 FROM sv UNION ALL SELECT seed, quality, toxic, 'compiled_plus', 0.9::DOUBLE * (0.5 * d + 0.5 * c) + 0.1::DOUBLE * u, 8 FROM sv),
sl AS (SELECT 'quality' AS task, variant, seed, w, quality y, s FROM sr UNION ALL SELECT 'toxic', variant, seed, w, toxic, s FROM sr),
sc AS (SELECT task, variant, seed, w, s, count(*) FILTER (y = 1) p, count(*) FILTER (y = 0) n FROM sl GROUP BY ALL),
sw AS (SELECT *, sum(p) OVER (k ORDER BY s DESC)::DOUBLE gp, sum(n) OVER (k ORDER BY s DESC)::DOUBLE gn, sum(p) OVER k::DOUBLE tp, sum(n) OVER k::DOUBLE tn
  FROM sc WINDOW k AS (PARTITION BY task, variant, seed)),
runs AS (
  SELECT 'docs' AS dataset, task, variant, seed::BIGINT seed, sum(p + n)::BIGINT n_val,
    round(sum(CASE WHEN s >= 0.5 THEN p ELSE n END)::DOUBLE / sum(p + n), 9) accuracy,
    round(sum(p * (tn - gn + n / 2.0)) / any_value(tp * tn), 9) roc_auc, round(sum(p * gp / (gp + gn)) / any_value(tp), 9) average_precision,
    round(-sum(p * ln(s) + n * ln(1 - s)) / sum(p + n), 9) log_loss, any_value(w)::BIGINT n_features
  FROM sw GROUP BY task, variant, seed)""".replace("sum(p) OVER (k ORDER", "sum(p) OVER (PARTITION BY task, variant, seed ORDER").replace(
    "sum(n) OVER (k ORDER", "sum(n) OVER (PARTITION BY task, variant, seed ORDER")

QUERIES["run_table"] = run_table
ORACLES["run_table"] = f"WITH {RUNS_SQL} SELECT * FROM runs"


@query("run_union_typed", f"""WITH {RUNS_SQL},
a AS (SELECT dataset, task, variant, seed, roc_auc, n_features, NULL AS failure_reason FROM runs WHERE variant != 'dfs'),
b AS (SELECT dataset, task, variant, seed, NULL::DOUBLE roc_auc, NULL::BIGINT n_features, CASE WHEN seed % 2 = 0 THEN 'out of memory' ELSE ' ' END failure_reason FROM runs WHERE variant = 'dfs')
SELECT *, CASE WHEN roc_auc IS NOT NULL THEN 'ok' ELSE 'failed' END AS status FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def run_union_typed(spark, sf):
    r = run_table(spark, sf)
    text = lambda c: F.col(c).cast("string").alias(c)
    a = r.where("variant != 'dfs'").select(*TASK, "variant", text("seed"), F.col("roc_auc"), text("n_features"))
    b = r.where("variant = 'dfs'").select(
        *TASK, "variant", text("seed"), F.when(F.col("seed") % 2 == 0, "out of memory").otherwise(" ").alias("failure_reason"),
    ).withColumn("n_features", F.lit("n/a"))
    return runs.typed_runs(runs.union_runs([a, b]))


@query("run_failures", f"""WITH {RUNS_SQL} SELECT dataset, task, variant, seed, 'failed' AS status,
  CASE WHEN seed % 2 = 0 THEN 'out of memory' ELSE ' ' END AS failure_reason FROM runs WHERE variant = 'dfs'""")
def run_failures(spark, sf):
    return runs.failure_log(run_union_typed(spark, sf), [*TASK, "variant", "seed", "status", "failure_reason"])


@query("run_only_tasks", f"""WITH {RUNS_SQL} SELECT dataset, task, variant, seed, roc_auc, 'harm' AS taxonomy FROM runs WHERE task = 'toxic'""")
def run_only_tasks(spark, sf):
    wanted = spark.createDataFrame([("docs", "toxic"), ("docs", "absent")], "dataset string, task string")
    kinds = spark.createDataFrame([("docs", "toxic", "harm"), ("docs", "quality", "use")], "dataset string, task string, taxonomy string")
    return runs.only_tasks(run_table(spark, sf).select(*TASK, "variant", "seed", "roc_auc"), wanted, TASK, kinds)


RAW = {"target_only": "Target_Only", "dfs": "regen_dfs_alone", "compiled": "x", "compiled_plus": ""}


@query("run_variants", f"""WITH {RUNS_SQL} SELECT dataset, task, seed,
  CASE variant WHEN 'target_only' THEN 'Target_Only' WHEN 'dfs' THEN 'regen_dfs_alone' WHEN 'compiled' THEN 'x' ELSE '' END AS raw,
  CASE variant WHEN 'target_only' THEN 'target_only' WHEN 'dfs' THEN 'dfs' WHEN 'compiled' THEN 'compiled_topk' ELSE 'unknown' END AS variant_normalised FROM runs""")
def run_variants(spark, sf):
    names = F.create_map(*[x for k, v in RAW.items() for x in (F.lit(k), F.lit(v))])
    path = F.when(F.col("variant") == "compiled", "/out/compiled/topk16/seed41.json").otherwise("/out/other.json")
    r = run_table(spark, sf).select(*TASK, "seed", F.element_at(names, F.col("variant")).alias("raw"), path.alias("path"))
    return runs.normalise_variants(
        r, "raw", {"regen_dfs_alone": "dfs"}, [(("compiled", "topk16"), "compiled_topk"), (("target_only",), "target_only"), (("compiled",), "compiled")], "path"
    ).drop("path")


@query("run_dedupe", f"""WITH {RUNS_SQL} SELECT dataset, task, variant, seed, CASE WHEN seed % 2 = 0 THEN 0 ELSE 1 END AS source_priority,
  roc_auc + CASE WHEN seed % 2 = 0 THEN 1 ELSE 0 END AS roc_auc FROM runs""")
def run_dedupe(spark, sf):
    """Even seeds also exist in a preferred source with another value."""
    r = run_table(spark, sf).select(*TASK, "variant", "seed", F.lit(1).alias("source_priority"), "roc_auc")
    better = r.where("seed % 2 = 0").withColumn("source_priority", F.lit(0)).withColumn("roc_auc", F.col("roc_auc") + 1)
    return runs.dedupe_runs(runs.union_runs([r, better]), [*TASK, "variant", "seed"], ["source_priority", "roc_auc"])


@query("run_best_candidate", f"""WITH {RUNS_SQL}
SELECT dataset, task, variant, seed, n_features, roc_auc, n_val AS n_train, n_val, 'ok' AS status,
  round(1e6 + 1e4 + 20 + 1 + CASE WHEN variant LIKE 'compiled%' THEN n_features ELSE -n_features END / 1000.0, 6) AS pick_score FROM runs WHERE seed = 42""")
def run_best_candidate(spark, sf):
    """The wanted seed with filled counts beats other seeds and rows without counts."""
    r = run_table(spark, sf).select(*TASK, "variant", "seed", "n_features", "roc_auc", F.col("n_val").alias("n_train"), "n_val", F.lit("ok").alias("status"))
    bare = r.withColumn("n_train", F.lit(None).cast("bigint")).withColumn("n_features", F.col("n_features") + 1)
    broken = r.withColumn("status", F.lit("failed"))
    out = runs.best_candidate(
        runs.union_runs([r, bare, broken]), [*TASK, "variant"], seed=42, wide_is_better=F.col("variant").startswith("compiled"), tiebreak=["n_features"]
    )
    return out.withColumn("pick_score", round_to("pick_score", 6))


def _summary(spark, sf, ddof):
    return runs.summarise_runs(run_table(spark, sf), [*TASK, "variant"], [*METRICS, "n_features"], ddof)


def _summary_sql(std, d=6):
    cols = ", ".join(f"{{r}}avg({m}){{e}} AS {m}_mean, {{r}}{std}({m}){{e}} AS {m}_std" for m in [*METRICS, "n_features"])
    return f"SELECT dataset, task, variant, count(seed) AS n_runs, string_agg(DISTINCT seed::VARCHAR, ',' ORDER BY seed::VARCHAR) AS seeds, {cols} FROM runs GROUP BY dataset, task, variant"


for _d, _s in ((0, "stddev_pop"), (1, "stddev_samp")):
    QUERIES[f"run_summary_ddof{_d}"] = lambda spark, sf, d=_d: rounded(_summary(spark, sf, d))
    ORACLES[f"run_summary_ddof{_d}"] = f"WITH {RUNS_SQL} " + _summary_sql(_s).replace("{r}", "round(").replace("{e}", ", 6)")

SUMMARY_CTE = f"{RUNS_SQL}, summary AS ({_summary_sql('stddev_samp').replace('{r}', '').replace('{e}', '')})"


@query("run_deltas", f"""WITH {SUMMARY_CTE}
SELECT s.dataset, s.task, s.variant, round(s.roc_auc_mean, 6) AS roc_auc_mean, round(s.log_loss_mean, 6) AS log_loss_mean,
  round(s.roc_auc_mean - b.roc_auc_mean, 6) AS delta_roc_auc_mean, round(s.log_loss_mean - b.log_loss_mean, 6) AS delta_log_loss_mean
FROM summary s LEFT JOIN summary b ON b.task = s.task AND b.variant = 'dfs'""")
def run_deltas(spark, sf):
    s = _summary(spark, sf, 1).select(*TASK, "variant", "roc_auc_mean", "log_loss_mean")
    return rounded(runs.deltas_to_baseline(s, TASK, "dfs", ["roc_auc_mean", "log_loss_mean"]))


OUT_ARGS = dict(
    baselines=["target_only", "dfs"], candidates=["compiled", "compiled_plus"], plain="dfs", compiled="compiled",
    temporal=["target_only"], static=["compiled"], temporal_kinds=["temporal_local_state"],
)


@query("run_outcome", f"""WITH {SUMMARY_CTE},
b AS (SELECT * FROM summary WHERE variant IN ('target_only', 'dfs') QUALIFY row_number() OVER (PARTITION BY task ORDER BY roc_auc_mean DESC, average_precision_mean DESC, log_loss_mean) = 1),
c AS (SELECT * FROM summary WHERE variant IN ('compiled', 'compiled_plus') QUALIFY row_number() OVER (PARTITION BY task ORDER BY roc_auc_mean DESC, average_precision_mean DESC, log_loss_mean) = 1),
d AS (SELECT b.dataset, b.task, b.variant bv, c.variant cv, c.roc_auc_mean - b.roc_auc_mean a, c.average_precision_mean - b.average_precision_mean p,
  c.log_loss_mean - b.log_loss_mean l FROM b JOIN c USING (task)),
t AS (SELECT task, max(roc_auc_mean) FILTER (variant = 'target_only') - max(roc_auc_mean) FILTER (variant = 'compiled') > 0.01 AND task = 'toxic' drift FROM summary GROUP BY task)
SELECT dataset, task, bv AS base_variant, cv AS cand_variant, round(a, 6) AS delta_roc_auc, round(p, 6) AS delta_ap, round(l, 6) AS delta_log_loss,
  CASE WHEN drift THEN 'temporal_diagnostic' WHEN (a > 0.002)::INT + (p > 0.002)::INT + (l < -0.002)::INT >= 2 THEN 'win'
    WHEN (a < -0.002)::INT + (p < -0.002)::INT + (l > 0.002)::INT >= 2 THEN 'loss' ELSE 'tie' END AS outcome FROM d JOIN t USING (task)""")
def run_outcome(spark, sf):
    s = _summary(spark, sf, 1)
    taxonomy = s.select(*TASK).distinct().withColumn("taxonomy", F.when(F.col("task") == "toxic", "temporal_local_state").otherwise("static"))
    return rounded(runs.classify_outcomes(s, taxonomy, TASK, **OUT_ARGS))


def _paired(spark, sf, base="dfs", cand="compiled_plus"):
    return gate.pair_runs(run_table(spark, sf), TASK, base, cand, METRICS)


PAIRED_CTE = f"""{RUNS_SQL}, paired AS (
  SELECT b.dataset, b.task, b.seed, b.roc_auc ba, c.roc_auc ca, b.log_loss bl, c.log_loss cl, b.accuracy bc, c.accuracy cc
  FROM runs b JOIN runs c ON b.task = c.task AND b.seed = c.seed AND b.variant = 'dfs' AND c.variant = 'compiled_plus')"""
QUERIES["gate_pairs"] = lambda spark, sf: _paired(spark, sf).select(*TASK, "seed", "base_roc_auc", "candidate_roc_auc", "base_log_loss", "candidate_log_loss")
ORACLES["gate_pairs"] = f"""WITH {PAIRED_CTE} SELECT dataset, task, seed, ba AS base_roc_auc, ca AS candidate_roc_auc, bl AS base_log_loss, cl AS candidate_log_loss FROM paired"""

SINGLE_SQL = """SELECT dataset, task, count(*) AS n_seeds, round(avg({g}), 6) AS mean_gain, round(min({g}), 6) AS min_gain,
  bool_and({g} > 1e-12) AS all_seeds_pass, CASE WHEN bool_and({g} > 1e-12) THEN 'SELECT' ELSE 'FALLBACK' END AS outcome FROM paired GROUP BY dataset, task"""
QUERIES["gate_single_maximise"] = lambda spark, sf: rounded(gate.single_gate(_paired(spark, sf), TASK, "base_roc_auc", "candidate_roc_auc"))
ORACLES["gate_single_maximise"] = f"WITH {PAIRED_CTE} " + SINGLE_SQL.format(g="(ca - ba)")
QUERIES["gate_single_minimise"] = lambda spark, sf: rounded(gate.single_gate(_paired(spark, sf), TASK, "base_log_loss", "candidate_log_loss", maximise=False))
ORACLES["gate_single_minimise"] = f"WITH {PAIRED_CTE} " + SINGLE_SQL.format(g="(bl - cl)")

LEX = (("base_accuracy", "candidate_accuracy"), ("base_roc_auc", "candidate_roc_auc"))
PASS = "((cc - bc) > 1e-12 OR (abs(cc - bc) <= 1e-12 AND (ca - ba) > 1e-12))"
QUERIES["gate_lexicographic"] = lambda spark, sf: rounded(gate.lexicographic_gate(_paired(spark, sf), TASK, *LEX))
ORACLES["gate_lexicographic"] = f"""WITH {PAIRED_CTE} SELECT dataset, task, count(*) AS n_seeds, round(avg(cc - bc), 6) AS mean_primary_gain,
  round(avg(ca - ba), 6) AS mean_secondary_gain, bool_and({PASS}) AS all_seeds_pass,
  CASE WHEN bool_and({PASS}) THEN 'SELECT' ELSE 'FALLBACK' END AS outcome FROM paired GROUP BY dataset, task"""


@query("gate_report", f"""WITH {PAIRED_CTE}, g AS (SELECT task, bool_and(ca - ba > 1e-12) ok FROM paired GROUP BY task)
SELECT p.dataset, p.task, seed, round(ba, 6) AS base_score, round(ca, 6) AS candidate_score, round(ca - ba, 6) AS improvement,
  CASE WHEN ok THEN 'SELECT' ELSE 'FALLBACK' END AS outcome, CASE WHEN ok THEN 'compiled_plus' ELSE 'dfs' END AS selected_variant,
  round(CASE WHEN ok THEN ca ELSE ba END, 6) AS selected_score, NOT ok AS fallback_exact_match FROM paired p JOIN g USING (task)""")
def gate_report(spark, sf):
    p = _paired(spark, sf)
    return rounded(gate.gate_report(p, gate.single_gate(p, TASK, "base_roc_auc", "candidate_roc_auc"), TASK, "roc_auc", "dfs", "compiled_plus"))


def _archive(spark, sf):
    """Archived decisions: everything selected."""
    return run_table(spark, sf).groupBy(*TASK).agg(
        F.lit("SELECT").alias("gate_outcome"), F.min("roc_auc").alias("base_score"), F.max("roc_auc").alias("candidate_score")
    )


ARCHIVE_CTE = "archive AS (SELECT dataset, task, 'SELECT' AS gate_outcome, min(roc_auc) base_score, max(roc_auc) candidate_score FROM runs GROUP BY dataset, task)"


@query("gate_override", f"""WITH {PAIRED_CTE}, {ARCHIVE_CTE},
n AS (SELECT task, CASE WHEN bool_and(ca - ba > 1e-12) THEN 'SELECT' ELSE 'FALLBACK' END o, avg(ba) b, avg(ca) c FROM paired WHERE task = 'toxic' GROUP BY task),
j AS (SELECT a.dataset, a.task, coalesce(o, gate_outcome) o, coalesce(b, base_score) b, coalesce(c, candidate_score) c, o IS NOT NULL r FROM archive a LEFT JOIN n USING (task))
SELECT dataset, task, o AS gate_outcome, round(b, 6) AS base_score, round(c, 6) AS candidate_score, round(CASE WHEN o = 'SELECT' THEN c ELSE b END, 6) AS selected_score,
  round(CASE WHEN o = 'SELECT' THEN c - b ELSE 0 END, 6) AS selected_gain, r AS recomputed FROM j""")
def gate_override(spark, sf):
    p = _paired(spark, sf).where("task = 'toxic'")
    fresh = p.groupBy(*TASK).agg(F.avg("base_roc_auc").alias("base_score"), F.avg("candidate_roc_auc").alias("candidate_score"))
    d = gate.single_gate(p, TASK, "base_roc_auc", "candidate_roc_auc").select(*TASK, F.col("outcome").alias("gate_outcome"))
    return rounded(gate.override_decisions(_archive(spark, sf), fresh.join(d, TASK), TASK))


def _audit(spark, sf):
    rows = gate.lexicographic_seed_rows(_paired(spark, sf), *LEX).withColumn("gate_mode", F.lit("lexicographic"))
    return gate.strict_audit(rows, _archive(spark, sf), TASK)


AUDIT_CTE = f"""{PAIRED_CTE}, {ARCHIVE_CTE}, au AS (
  SELECT dataset, task, bool_and({PASS}) ok, avg(cc - bc) g, count(*) n, count(*) FILTER (NOT {PASS}) bad FROM paired GROUP BY dataset, task)"""


@query("gate_strict_audit", f"""WITH {AUDIT_CTE} SELECT dataset, task, 'lexicographic' AS gate_mode, ok AS all_seeds_pass, round(g, 6) AS mean_primary_gain, n::INT AS n_seeds,
  bad AS failed_seeds, 'SELECT' AS legacy_gate, CASE WHEN ok THEN 'SELECT' ELSE 'FALLBACK' END AS strict_gate,
  CASE WHEN ok THEN 'all_seeds_strictly_pass' ELSE 'lexicographic_seed_inconsistency_fallback' END AS gate_reason, ok AS gate_matches_legacy FROM au""")
def gate_strict_audit(spark, sf):
    return rounded(_audit(spark, sf))


def _special(spark):
    return spark.createDataFrame([("docs", "quality", "comparison_scope_mismatch", "FALLBACK")], "dataset string, task string, mismatch_class string, recommended_gate string")


@query("gate_reconcile", f"""WITH {AUDIT_CTE} SELECT dataset, task, 'SELECT' AS legacy_gate, CASE WHEN ok THEN 'SELECT' ELSE 'FALLBACK' END AS strict_gate,
  CASE WHEN task = 'quality' THEN 'comparison_scope_mismatch' WHEN ok THEN 'agreement' ELSE 'unexplained' END AS mismatch_class,
  CASE WHEN task = 'quality' THEN 'FALLBACK' WHEN ok THEN 'SELECT' ELSE 'FALLBACK' END AS recommended_gate,
  CASE WHEN ok THEN 'all_seeds_strictly_pass' ELSE 'lexicographic_seed_inconsistency_fallback' END AS gate_reason FROM au""")
def gate_reconcile(spark, sf):
    return gate.reconcile(_audit(spark, sf), _special(spark), TASK)


@query("gate_provenance", f"""WITH {AUDIT_CTE}, inv AS (SELECT dataset, task, gate_outcome FROM archive UNION ALL SELECT 'docs', 'unscored', 'NOT_EVALUATED'),
q AS (SELECT dataset, task, CASE WHEN ok THEN 'SELECT' ELSE 'FALLBACK' END s, CASE WHEN task = 'quality' THEN 'FALLBACK' WHEN ok THEN 'SELECT' ELSE 'FALLBACK' END r,
  CASE WHEN task = 'quality' THEN 'comparison_scope_mismatch' WHEN ok THEN 'agreement' ELSE 'unexplained' END m FROM au)
SELECT inv.dataset, inv.task, gate_outcome, s AS strict_gate, r AS recommended_gate, m AS mismatch_class, coalesce(r, s, gate_outcome) AS final_gate,
  CASE WHEN m IS NOT NULL AND m != 'agreement' THEN 'reconciled' WHEN s IS NOT NULL THEN 'strict_audit' ELSE 'archive' END AS provenance FROM inv LEFT JOIN q USING (task)""")
def gate_provenance(spark, sf):
    a = _audit(spark, sf)
    extra = spark.createDataFrame([("docs", "unscored", "NOT_EVALUATED")], "dataset string, task string, gate_outcome string")
    inventory = _archive(spark, sf).select(*TASK, "gate_outcome").unionByName(extra)
    return gate.provenance(inventory, a, gate.reconcile(a, _special(spark), TASK), TASK)


@query("metric_coverage", f"""WITH {RUNS_SQL} SELECT dataset, task, count(*) FILTER (variant = 'dfs' AND (task = 'quality' OR seed != 43)) AS seeds_dfs, count(*) FILTER (variant = 'compiled') AS seeds_compiled,
  CASE WHEN task = 'quality' THEN 'accuracy,roc_auc,average_precision,log_loss' ELSE '' END AS complete_metrics FROM runs WHERE variant IN ('dfs', 'compiled') GROUP BY dataset, task""")
def metric_coverage(spark, sf):
    """Task toxic misses one baseline seed."""
    r = run_table(spark, sf).where("not (task = 'toxic' and variant = 'dfs' and seed = 43)")
    return gate.metric_coverage(r, TASK, ["dfs", "compiled"], METRICS, SEEDS)


@query("seed_gaps", f"""WITH {PAIRED_CTE} SELECT dataset, task, string_agg(seed::VARCHAR, ',' ORDER BY seed) AS seeds FROM paired
WHERE NOT (task = 'toxic' AND seed = 43) GROUP BY dataset, task HAVING count(*) < 4""")
def seed_gaps(spark, sf):
    return gate.require_seeds(_paired(spark, sf).where("not (task = 'toxic' and seed = 43)"), TASK, SEEDS)


@query("gate_outcome_counts", f"""WITH {PAIRED_CTE}, g AS (SELECT dataset, task, CASE WHEN bool_and(ca - ba > 1e-12) THEN 'SELECT' ELSE 'FALLBACK' END AS outcome FROM paired GROUP BY dataset, task)
SELECT dataset, outcome, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM g), 6) AS fraction FROM g GROUP BY dataset, outcome""")
def gate_outcome_counts(spark, sf):
    d = gate.single_gate(_paired(spark, sf), TASK, "base_roc_auc", "candidate_roc_auc")
    return rounded(runs.outcome_counts(d, ["dataset"], "outcome"))


@query("completeness", f"""WITH {PAIRED_CTE}, g AS (SELECT task, CASE WHEN bool_and(ca - ba > 1e-12) THEN 'SELECT' ELSE 'FALLBACK' END o FROM paired WHERE task = 'toxic' GROUP BY task),
reg AS (SELECT * FROM (VALUES ('docs', 'quality', 'binary'), ('docs', 'toxic', 'binary'), ('docs', 'absent', 'regression')) t(dataset, task, task_type))
SELECT reg.*, CASE WHEN o = 'SELECT' THEN 'COMPLETE_EVALUATED_SELECT' WHEN o = 'FALLBACK' THEN 'COMPLETE_FALLBACK' WHEN task = 'quality' THEN 'EVALUATED_MISSING_GATE' ELSE 'NOT_STARTED' END AS completion_status,
  task != 'absent' AS metric_complete, task != 'absent' AS has_all_seeds, CASE WHEN task = 'absent' THEN '' ELSE '41;42;43;44' END AS seeds_found, coalesce(o, '') AS gate_outcomes
FROM reg LEFT JOIN g USING (task)""")
def completeness(spark, sf):
    registry = spark.createDataFrame([("docs", "quality", "binary"), ("docs", "toxic", "binary"), ("docs", "absent", "regression")], "dataset string, task string, task_type string")
    d = gate.single_gate(_paired(spark, sf).where("task = 'toxic'"), TASK, "base_roc_auc", "candidate_roc_auc")
    gates = d.select(*TASK, F.col("outcome").alias("gate_outcome"))
    rows = run_table(spark, sf).withColumn("rmse", F.lit(None).cast("double"))
    return runs.completeness(registry, rows, gates, TASK, {"binary": ["accuracy", "roc_auc", "log_loss"], "regression": ["rmse"]}, SEEDS)


@query("oracle_gap", f"""WITH {RUNS_SQL}, o AS (SELECT task, seed, roc_auc v FROM runs WHERE variant = 'compiled_plus')
SELECT variant, count(*) AS n_runs, round(avg(roc_auc), 6) AS roc_auc_mean, round(avg(roc_auc - v), 6) AS gap_mean, round(min(roc_auc - v), 6) AS gap_min FROM runs JOIN o USING (task, seed) GROUP BY variant""")
def oracle_gap(spark, sf):
    return rounded(rank.oracle_gap(run_table(spark, sf), "roc_auc", "variant", "compiled_plus", [*TASK, "seed"]))


def _logs(spark, sf):
    """One report per event, written from its own numbers."""
    e = load(spark, sf, "events")
    clock = F.when(
        F.col("event_id") % 2 == 0,
        F.format_string("%d:%02d:%02d", (F.col("event_id") % 5 + 1).cast("int"), (F.col("event_id") % 60).cast("int"), (F.col("user_id") % 60).cast("int")),
    ).otherwise(F.format_string("%d:%05.2f", (F.col("event_id") % 60).cast("int"), (F.col("user_id") % 60) + F.lit(0.25)))
    text = F.concat(
        F.lit("\tUser time (seconds): "), (F.col("event_id") % 1000).cast("string"), F.lit(".50\n\tSystem time (seconds): 1.25\n"),
        F.lit("\tElapsed (wall clock) time (h:mm:ss or m:ss): "), clock, F.lit("\n\tMaximum resident set size (kbytes): "),
        ((F.col("event_id") % 7 + 1) * 1024).cast("string"), F.lit("\n"),
    )
    return e.select("event_id", "user_id", text.alias("text"))


@query("timing_log", """
SELECT event_id, (CASE WHEN event_id % 2 = 0 THEN (event_id % 5 + 1) * 3600 + (event_id % 60) * 60 + user_id % 60
   ELSE (event_id % 60) * 60 + user_id % 60 + 0.25 END)::DOUBLE AS elapsed_wall_time_sec, (event_id % 1000 + 0.5)::DOUBLE AS user_time_sec,
  1.25::DOUBLE AS system_time_sec, (event_id % 7 + 1)::DOUBLE AS peak_memory_mb FROM events""")
def timing_log(spark, sf):
    return _logs(spark, sf).select("event_id", *[e.alias(n) for n, e in run_files.parse_timing(F.col("text")).items()])


@query("result_paths", """SELECT event_id, 'rel-' || event_type AS dataset, 'user-' || event_type AS task, (user_id % 4 + 41)::BIGINT AS seed FROM events""")
def result_paths(spark, sf):
    path = F.concat(F.lit("/runs/rel-"), "event_type", F.lit("/user_"), "event_type", F.lit("/seed_"), (F.col("user_id") % 4 + 41).cast("string"), F.lit("/m.json"))
    return load(spark, sf, "events").select("event_id", *[e.alias(n) for n, e in run_files.from_path(path).items()])


@query("efficiency_join", f"""WITH {RUNS_SQL},
ev AS (SELECT CASE user_id % 2 WHEN 0 THEN 'dfs' ELSE 'compiled' END v, max(CASE WHEN event_id % 2 = 0 THEN (event_id % 5 + 1) * 3600 + (event_id % 60) * 60 + user_id % 60
   ELSE (event_id % 60) * 60 + user_id % 60 + 0.25 END)::DOUBLE t, max(event_id % 7 + 1)::DOUBLE m FROM events GROUP BY 1),
ex AS (SELECT max(t) t, max(m) m FROM ev)
SELECT dataset, task, variant, 'score' AS model, seed, round(roc_auc, 6) AS roc_auc, CASE WHEN task = 'toxic' THEN ex.t END AS export_elapsed_wall_time_sec,
  CASE WHEN task = 'toxic' THEN ex.m END AS export_peak_memory_mb, CASE WHEN task = 'toxic' THEN ev.t END AS eval_elapsed_wall_time_sec,
  CASE WHEN task = 'toxic' THEN ev.m END AS eval_peak_memory_mb FROM runs, ex LEFT JOIN ev ON v = variant""".replace("FROM runs, ex LEFT JOIN ev", "FROM (SELECT * FROM runs) runs CROSS JOIN ex LEFT JOIN ev"))
def efficiency_join(spark, sf):
    logs = _logs(spark, sf)
    timed = logs.select(
        F.lit("docs").alias("dataset"), F.lit("toxic").alias("task"), F.lit("score").alias("model"),
        F.when(F.col("user_id") % 2 == 0, "dfs").otherwise("compiled").alias("variant"),
        *[e.alias(n) for n, e in run_files.parse_timing(F.col("text")).items()],
    )
    timing = timed.withColumn("stage", F.lit("eval")).unionByName(timed.withColumn("stage", F.lit("export")))
    m = run_table(spark, sf).select(*TASK, "variant", F.lit("score").alias("model"), "seed", "roc_auc")
    return rounded(runs.efficiency_table(m, timing, "export", "eval"))


def _in_range(c):
    return F.coalesce((F.col(c) >= 0) & (F.col(c) <= 1), F.lit(False))


@query("decoder_scores", "SELECT doc_id, quality::DOUBLE AS y_true, true AS score_in_range FROM labels JOIN documents USING (doc_id)")
def decoder_scores(spark, sf):
    """Boosted trees on document features: every labelled document is scored by a model of the other half."""
    d = labelled_once(spark, sf)
    folds = [
        learn.score_matrix(d.where(f"doc_id % 2 != {k}"), d.where(f"doc_id % 2 = {k}"), label="quality", features=DOC_FEATURES, row_key=["doc_id"])
        for k in range(2)
    ]
    return reduce(lambda a, b: a.unionByName(b), folds).select("doc_id", "y_true", _in_range("y_score").alias("score_in_range"))


def _calibration_rows(df, columns, key, right):
    s = dep.calibration_statistics(df, columns, row_key=[key], replicates=4)
    known = F.concat_ws(">", "lhs", "rhs").isin(right)
    return s.withColumn("schema_flag", F.lit(0)).withColumn("truth", known.cast("int"))


SUPPLIER_COLS = ["s_nationkey", "s_nation", "s_region", "s_cents"]


@query("dependency_calibrator", " UNION ALL ".join(
    f"SELECT '{a}' AS lhs, '{b}' AS rhs, {int((a, b) in [('s_nationkey', 's_nation'), ('s_nation', 's_nationkey'), ('s_nationkey', 's_region'), ('s_nation', 's_region')])} AS truth, "
    "true AS probability_in_range, true AS ordered FROM (SELECT 1 WHERE (SELECT count(*) FROM supplier) > 0)"
    for a in SUPPLIER_COLS for b in SUPPLIER_COLS if a != b
))
def dependency_calibrator(spark, sf):
    """Fitted on the dependencies of customers, applied to those of suppliers; true ones rank first on average."""
    fit = _calibration_rows(customer_geo(spark, sf), GEO_COLS, "c_custkey", ["n_name>r_name", "n_name>n_regionkey", "n_regionkey>r_name"])
    n, r = load(spark, sf, "nation"), load(spark, sf, "region")
    s = load(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, n.n_regionkey == r.r_regionkey)
    s = s.select("s_suppkey", "s_nationkey", F.col("n_name").alias("s_nation"), F.col("r_name").alias("s_region"), F.floor(F.col("s_acctbal") * 100 % 100).alias("s_cents"))
    truth = ["s_nationkey>s_nation", "s_nation>s_nationkey", "s_nationkey>s_region", "s_nation>s_region"]
    out = learn.calibration_heuristic(learn.calibrate_dependencies(fit, "truth", score=_calibration_rows(s, SUPPLIER_COLS, "s_suppkey", truth)))
    mean = lambda t: F.avg(F.when(F.col("truth") == t, F.col("heuristic"))).over(W.partitionBy())  # noqa: E731  one row per column pair
    return out.select("lhs", "rhs", "truth", _in_range("probability").alias("probability_in_range"), (mean(1) > mean(0)).alias("ordered"))


ORDER_FEATURES = ["o_totalprice", "month", "weekday", "n_letters"]


@query("program_ranker", " UNION ALL ".join(f"SELECT '{f}' AS feature, true AS score_in_range FROM (SELECT 1 WHERE (SELECT count(*) FROM orders) > 0)" for f in ORDER_FEATURES))
def program_ranker(spark, sf):
    """Learned from the profiles of document features, applied to those of order features."""
    meta = ["nonnull_rate", "distinct_ratio", "std", "mean_abs", "is_count", "is_share"]
    rules = {"is_count": F.col("feature").startswith("n_"), "is_share": F.col("feature").contains("share")}
    known = rank.rule_features(rank.feature_profile(doc_features(spark, sf), DOC_FEATURES), rules)
    known = known.withColumn("known", F.col("feature").isin("digit_share", "n_words").cast("int"))
    o = load(spark, sf, "orders").select("o_totalprice", F.month("o_orderdate").alias("month"), F.dayofweek("o_orderdate").alias("weekday"), F.length("o_orderpriority").alias("n_letters"))
    new = rank.rule_features(rank.feature_profile(o, ORDER_FEATURES), rules)
    return learn.learn_program_ranker(known, new, meta, "known").select("feature", _in_range("ranker_score").alias("score_in_range"))


# Databases the ranker is tried on: child table, entity key, amount, time, category, and the two programs behind the label.
RANKED_DATABASES = {
    "buyers": ("orders", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority", ("hist_count", "hist_mean")),
    "orders": ("lineitem", "l_orderkey", "l_extendedprice", "l_shipdate", "l_returnflag", ("hist_mean", "hist_days_since_last")),
    "parts": ("lineitem", "l_partkey", "l_quantity", "l_shipdate", "l_returnflag", ("hist_count", "f_amb__flag__majconf")),
    "suppliers": ("lineitem", "l_suppkey", "l_extendedprice", "l_shipdate", "l_linestatus", ("hist_std", "hist_count")),
    "users": ("events", "user_id", "value", "ts", "event_type", ("f_amb__flag__majconf", "hist_max")),
}
PROGRAMS = ["hist_count", "hist_mean", "hist_std", "hist_max", "hist_days_since_last", "f_amb__flag__majconf", "key_digit", "key_hash", "hist_std__is_missing"]


def program_candidates(spark, sf):
    """Candidate programs of five databases with their metadata; a label is made of two of them, above their mean together."""
    out = []
    for name, (table, key, amount, time, kind, truth) in RANKED_DATABASES.items():
        child = load(spark, sf, table).select(F.col(key).alias("k"), F.col(amount).cast("double").alias("v"), F.col(time).alias("t"), F.col(kind).alias("c"))
        last = child.agg(F.max("t")).scalar()
        most = child.groupBy("k", "c").agg(F.count("*").alias("n")).groupBy("k").agg((F.max("n") / F.sum("n")).alias("f_amb__flag__majconf"))
        entity = child.groupBy("k").agg(
            F.count("*").cast("double").alias("hist_count"), F.avg("v").alias("hist_mean"), F.stddev_samp("v").alias("hist_std"),
            F.max("v").alias("hist_max"), F.max("t").alias("latest"),
        ).join(most, "k").withColumn("hist_days_since_last", F.datediff(last, "latest").cast("double"))
        entity = entity.withColumns({
            "key_digit": (F.col("k") % 10).cast("double"), "key_hash": F.pmod(F.crc32(F.col("k").cast("string").cast("binary")), F.lit(1000)).cast("double"),
            "hist_std__is_missing": F.col("hist_std").isNull().cast("double"),
        })
        about = entity.agg(*[F.avg(c).alias(f"m_{c}") for c in truth], *[F.stddev_pop(c).alias(f"s_{c}") for c in truth])
        entity = entity.crossJoin(F.broadcast(about))  # one row
        level = sum((F.coalesce(F.try_divide(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}")), F.lit(0.0)) for c in truth), F.lit(0.0))
        entity = entity.withColumn("y", (level > 0).cast("double"))
        shape = rank.feature_profile(entity, PROGRAMS)
        profile = rank.heuristic_scores(shape, "hist_").select("feature", "heuristic_score")
        known_y = {c: F.when(F.col(c).isNotNull(), F.col("y")) for c in PROGRAMS}
        spread = {c: F.stddev_pop(c) * F.stddev_pop(known_y[c]) for c in PROGRAMS}
        tied = entity.agg(*[F.abs(F.try_divide(F.covar_pop(F.col(c), F.col("y")), spread[c])).alias(c) for c in PROGRAMS])
        tied = tied.unpivot([], PROGRAMS, "feature", "association")
        rules = {"is_aggregation": F.col("feature").startswith("hist_"), "is_ambiguity": F.col("feature").startswith("f_amb__"), "is_flag": F.col("feature").endswith("__is_missing")}
        known = rank.rule_features(shape, rules).join(profile, "feature").join(tied, "feature")
        out.append(known.select(F.lit(name).alias("dataset"), "*", F.col("feature").isin(*truth).cast("int").alias("known")))
    return reduce(lambda a, b: a.unionByName(b), out)


@query("program_ranker_held_out")
def program_ranker_held_out(spark, sf):
    """Per database and K the share of the programs behind its label that a ranker of the other databases finds, beside the heuristic's share."""
    ensure_checkpoint_dir(spark)
    found = program_candidates(spark, sf).checkpoint()  # some rows a database, read for every pair, score and rank
    meta = ["nonnull_rate", "distinct_ratio", "std", "mean_abs", "association", "is_aggregation", "is_ambiguity", "is_flag"]
    learned = learn.rank_held_out(found, group="dataset", item="feature", label="known", features=meta)
    plain = rank.ranked(found, [F.desc("heuristic_score"), F.col("feature")], groups=["dataset"])
    truth = found.where("known = 1").select("dataset", "feature")
    recall = lambda r: rank.program_recall(r, truth, [1, 2, 4], ["dataset"])
    beside = recall(plain).select("dataset", "k", F.col("recall").alias("heuristic_recall"))
    return recall(learned).join(beside, ["dataset", "k"])
