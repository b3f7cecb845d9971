"""Experiment-run tables: align, normalise, de-duplicate, summarise, compare, classify."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.scan import first_row

# Type of each run column.
INT_COLUMNS = ["seed", "n_train", "n_val", "n_features", "feature_budget", "dmax"]
FLOAT_COLUMNS = ["accuracy", "roc_auc", "average_precision", "log_loss", "runtime_sec"]
BOOL_COLUMNS = ["uses_afd", "uses_ambiguity", "uses_dmax2", "uses_supervised_ranker"]
METRIC_COLUMNS = ["accuracy", "roc_auc", "average_precision", "log_loss"]


def union_runs(tables: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column absent from a table is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def typed_runs(df: DataFrame) -> DataFrame:
    """Text columns to their run types (bad text is NULL) and a status for every row.

    A given status stays; else a failure reason means failed; else any metric means ok.
    """
    have = set(df.columns)
    cols: list[Column] = []
    for c in df.columns:
        if c in INT_COLUMNS:
            cols.append(F.col(c).try_cast("double").cast("bigint").alias(c))
        elif c in FLOAT_COLUMNS:
            cols.append(F.col(c).try_cast("double").alias(c))
        elif c in BOOL_COLUMNS:
            cols.append(F.col(c).try_cast("boolean").alias(c))
        else:
            cols.append(F.col(c))
    out = df.select(*cols)

    def said(c: str) -> Column:
        return F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) if c in have else F.lit(None).cast("string")

    metrics = [F.col(c) for c in METRIC_COLUMNS if c in have]
    any_metric = F.coalesce(*metrics).isNotNull() if metrics else F.lit(False)
    status = F.coalesce(
        said("status"), F.when(said("failure_reason").isNotNull(), "failed"), F.when(any_metric, "ok"), F.lit("failed")
    )
    return out.withColumn("status", status)


def only_tasks(runs: DataFrame, wanted: DataFrame, task: Sequence[str], attributes: DataFrame | None = None) -> DataFrame:
    """Runs of the wanted (dataset, task) pairs, with task attributes attached if given."""
    kept = runs.join(wanted.select(*task).distinct(), list(task), "left_semi")
    return kept if attributes is None else kept.join(attributes, list(task), "left")


def failure_log(runs: DataFrame, columns: Sequence[str]) -> DataFrame:
    return runs.where(F.col("status") != "ok").select(*columns)


def normalise_variants(df: DataFrame, column: str, aliases: Mapping[str, str], rules: Sequence[tuple[Sequence[str], str]], path: str | None = None) -> DataFrame:
    """Canonical variant names: exact alias first, then the first rule whose every needle occurs.

    Needles are looked up in the lower-case name and, if given, the result path.
    """
    raw = F.lower(F.trim(F.col(column)))
    text = F.lower(F.concat_ws(" ", F.col(column), F.col(path))) if path else raw
    out = F.lit(None).cast("string")
    for needles, name in reversed(list(rules)):
        hit = reduce(lambda a, b: a & b, [text.contains(n.lower()) for n in needles])
        out = F.when(hit, F.lit(name)).otherwise(out)
    if aliases:
        table = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k.lower()), F.lit(v))])
        out = F.coalesce(F.try_element_at(table, raw), out)
    fallback = F.coalesce(F.nullif(F.trim(F.col(column)), F.lit("")), F.lit("unknown"))
    return df.withColumn("variant_normalised", F.coalesce(out, fallback))


def dedupe_runs(runs: DataFrame, key: Sequence[str], priority: Sequence[str]) -> DataFrame:
    """One row per key: the smallest by ``priority`` (source rank, path, ...); combines map-side."""
    return first_row(runs, key, [F.col(c) for c in priority])


def best_candidate(runs: DataFrame, key: Sequence[str], *, seed: int, wide_is_better: Column, tiebreak: Sequence[str]) -> DataFrame:
    """Best row per key: success, wanted seed, filled counts (10 each), metric present, expected width."""
    ok = F.lower("status").isin("ok", "success")
    width = F.coalesce(F.col("n_features").cast("double"), F.when(wide_is_better, F.lit(-1.0)).otherwise(F.lit(999.0))) / 1000
    score = (
        F.when(ok, 1e6).otherwise(0.0) + F.when(F.col("seed") == seed, 1e4).otherwise(0.0)
        + F.when(F.col("n_train").isNotNull(), 10.0).otherwise(0.0) + F.when(F.col("n_val").isNotNull(), 10.0).otherwise(0.0)
        + F.when(F.col("roc_auc").isNotNull(), 1.0).otherwise(0.0) + F.when(wide_is_better, width).otherwise(-width)
    )
    scored = runs.withColumn("pick_score", score)
    return first_row(scored, key, [-F.col("pick_score"), *[F.col(c) for c in tiebreak]])


def summarise_runs(runs: DataFrame, by: Sequence[str], metrics: Sequence[str], ddof: int = 1) -> DataFrame:
    """Runs, sorted seed list, mean and std per metric; ``ddof`` picks the std convention."""
    std = {0: F.stddev_pop, 1: F.stddev_samp}[ddof]
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), std(m).alias(f"{m}_std")]
    seeds = F.array_join(F.transform(F.sort_array(F.collect_set("seed")), lambda s: s.cast("string")), ",")
    return runs.groupBy(*by).agg(F.count("seed").alias("n_runs"), seeds.alias("seeds"), *aggs)


def outcome_counts(decisions: DataFrame, by: Sequence[str], outcome: str) -> DataFrame:
    """Count per group and outcome, and its share of the group."""
    counts = decisions.groupBy(*by, outcome).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(*by))  # one row per group and outcome by now
    return counts.select(*by, outcome, "n", (F.col("n") / total).alias("fraction"))


def completeness(
    registry: DataFrame, runs: DataFrame, gates: DataFrame, task: Sequence[str], required: Mapping[str, Sequence[str]], seeds: Sequence[int]
) -> DataFrame:
    """Registry with metric presence, seed coverage and a completion status by precedence.

    ``required`` maps task_type to its metrics. Gates: SELECT over FALLBACK over NOT_EVALUATED.
    """
    metrics = sorted({m for ms in required.values() for m in ms})
    seen = runs.groupBy(*task).agg(
        F.count("*").alias("n_runs"), F.sort_array(F.collect_set(F.col("seed").cast("bigint"))).alias("__seeds"),
        *[F.max(F.col(m).isNotNull()).alias(f"has_{m}") for m in metrics],
    )
    marks = gates.groupBy(*task).agg(F.collect_set("gate_outcome").alias("__gates"))
    j = registry.join(seen, list(task), "left").join(marks, list(task), "left")
    complete = F.lit(False)
    for kind, ms in required.items():
        all_there = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"has_{m}"), F.lit(False)) for m in ms])
        complete = F.when(F.col("task_type") == kind, all_there).otherwise(complete)
    need = F.array(*[F.lit(s).cast("bigint") for s in seeds])
    four = F.coalesce(F.size(F.array_except(need, "__seeds")) == 0, F.lit(False))
    gate = lambda g: F.coalesce(F.array_contains("__gates", g), F.lit(False))
    any_seed = F.coalesce(F.size("__seeds"), F.lit(0)) > 0
    status = (
        F.when(gate("SELECT"), "COMPLETE_EVALUATED_SELECT").when(gate("FALLBACK"), "COMPLETE_FALLBACK")
        .when(gate("NOT_EVALUATED"), "COMPLETE_NOT_EVALUATED").when(complete & four, "EVALUATED_MISSING_GATE")
        .when(complete & any_seed, "PARTIAL_SEEDS_OR_BASELINE_ONLY")
        .when(F.coalesce("n_runs", F.lit(0)) > 0, "INCOMPLETE_ARTIFACTS").otherwise("NOT_STARTED")
    )
    return j.select(
        *registry.columns, status.alias("completion_status"), complete.alias("metric_complete"), four.alias("has_all_seeds"),
        F.coalesce(F.array_join(F.transform("__seeds", lambda s: s.cast("string")), ";"), F.lit("")).alias("seeds_found"),
        F.coalesce(F.array_join(F.sort_array("__gates"), ";"), F.lit("")).alias("gate_outcomes"),
    )


def deltas_to_baseline(summary: DataFrame, task: Sequence[str], baseline: str, metrics: Sequence[str]) -> DataFrame:
    """Every variant's metric minus the baseline variant's, within its task."""
    base = summary.where(F.col("variant") == baseline).select(*task, *[F.col(m).alias(f"__b_{m}") for m in metrics])
    return summary.join(base, list(task), "left").select(
        *summary.columns, *[(F.col(m) - F.col(f"__b_{m}")).alias(f"delta_{m}") for m in metrics]
    )


def best_of(summary: DataFrame, task: Sequence[str], variants: Sequence[str]) -> DataFrame:
    """Best variant per task by AUC, then AP, then log-loss."""
    rows = summary.where(F.col("variant").isin(list(variants)) & F.col("roc_auc_mean").isNotNull())
    return first_row(rows, task, [-F.col("roc_auc_mean"), -F.col("average_precision_mean"), F.col("log_loss_mean"), F.col("variant")])


def classify_outcomes(
    summary: DataFrame, taxonomy: DataFrame, task: Sequence[str], *, baselines: Sequence[str], candidates: Sequence[str],
    plain: str, compiled: str, temporal: Sequence[str], static: Sequence[str], temporal_kinds: Sequence[str], margin: float = 0.002,
) -> DataFrame:
    """win / tie / loss / fallback / temporal_diagnostic / insufficient_results per task.

    The best candidate is compared with the best baseline on AUC, AP and log-loss: two of three beyond
    ``margin`` decide. Equal scores and widths of ``compiled`` and ``plain`` mean fallback; for temporal
    tasks a temporal baseline more than 0.01 AUC above the static candidates is reported as such.
    """
    m = ["roc_auc_mean", "average_precision_mean", "log_loss_mean"]

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*task, F.col("variant").alias(f"{tag}_variant"), *[F.col(c).alias(f"{tag}_{c}") for c in m], F.col("n_features_mean").alias(f"{tag}_width"))

    out = summary.select(*task).distinct().join(taxonomy, list(task), "left")
    sides = {
        "base": best_of(summary, task, baselines), "cand": best_of(summary, task, candidates),
        "plain": best_of(summary, task, [plain]), "comp": best_of(summary, task, [compiled]),
        "temp": best_of(summary, task, temporal), "stat": best_of(summary, task, static),
    }
    for tag, df in sides.items():
        out = out.join(side(df, tag), list(task), "left")
    d = [F.col(f"cand_{c}") - F.col(f"base_{c}") for c in m]
    better = (d[0] > margin).cast("int") + (d[1] > margin).cast("int") + (d[2] < -margin).cast("int")
    worse = (d[0] < -margin).cast("int") + (d[1] < -margin).cast("int") + (d[2] > margin).cast("int")
    same = reduce(lambda a, b: a & b, [F.abs(F.col(f"comp_{c}") - F.col(f"plain_{c}")) < 1e-9 for c in [*m, "width"]])
    drift = F.col("taxonomy").isin(list(temporal_kinds)) & (F.col("temp_roc_auc_mean") - F.col("stat_roc_auc_mean") > 0.01)
    outcome = (
        F.when(F.col("base_variant").isNull() | F.col("cand_variant").isNull(), "insufficient_results")
        .when(same, "fallback").when(drift, "temporal_diagnostic").when(better >= 2, "win").when(worse >= 2, "loss").otherwise("tie")
    )
    return out.select(
        *task, "base_variant", "cand_variant", d[0].alias("delta_roc_auc"), d[1].alias("delta_ap"), d[2].alias("delta_log_loss"),
        outcome.alias("outcome"),
    )


def efficiency_table(metrics: DataFrame, timing: DataFrame, export_stage: str, eval_stage: str) -> DataFrame:
    """Metrics beside feature-export and evaluation timings of the same variant and model."""
    cols = ["elapsed_wall_time_sec", "peak_memory_mb"]
    export = timing.where(F.col("stage") == export_stage).groupBy("dataset", "task").agg(*[F.max(c).alias(f"export_{c}") for c in cols])
    evals = timing.where(F.col("stage") == eval_stage).groupBy("dataset", "task", "variant", "model").agg(*[F.max(c).alias(f"eval_{c}") for c in cols])
    return metrics.join(export, ["dataset", "task"], "left").join(evals, ["dataset", "task", "variant", "model"], "left")


def display_order(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Sort by a given list of values; unknown values come last by name."""
    place = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column))
    return df.orderBy(F.when(place > 0, place).otherwise(len(order) + 1), column)
