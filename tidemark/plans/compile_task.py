"""One prediction task end to end: features, dependencies, candidate matrix, gate, exact fallback.

Operators may count rows per key when called, to choose slices; the edges (at most ``k`` rows) are the one
driver round trip that later columns depend on.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import hash_int, key_text
from tidemark.operators import assemble, dependency, gate, history, learn, metrics, paths, prepare, temporal
from tidemark.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class TaskSpec:
    """Explicit columns of a task; nothing is guessed from names."""

    name: str
    row_key: Sequence[str]
    target_key: str
    target_time: str
    label: str
    child_table: str
    child_key: str
    child_time: str
    value: str
    prefix: str
    cutoff: str = "inclusive"
    task: str = "binary"
    entity_table: str | None = None
    entity_key: str | None = None
    entity_time: str | None = None
    dependency_columns: Sequence[str] = ()
    id_columns: Sequence[str] = ()
    max_edges: int = 1
    thresholds: Mapping[str, float] = field(default_factory=dict)
    #: further feature blocks: {"operator": a name in BLOCKS, "tables": [names], "args": {...}}
    blocks: Sequence[Mapping] = ()
    #: share of the training rows that a seed fits on, drawn by hash
    keep_percent: int = 80
    #: "single", or "lexicographic" with two metrics
    gate_mode: str = "single"
    gate_metrics: Sequence[str] = ()

    @staticmethod
    def read(path: str) -> TaskSpec:
        with open(path, encoding="utf-8") as f:
            return TaskSpec(**json.load(f))


# The metric a task is gated on and whether larger is better.
GATE_METRIC = {"binary": ("roc_auc", True), "logistic": ("roc_auc", True), "multiclass": ("accuracy", True), "regression": ("rmse", False)}
SEEDS = (41, 42, 43, 44)
SMALLER_IS_BETTER = {"rmse", "mae", "log_loss", "log_rmse", "log_mae", "median_abs_error"}
BLOCKS = {
    "point_in_time": temporal.point_in_time_features, "latest_value": temporal.latest_value, "lookback": temporal.lookback_features, "distinct_history": history.distinct_history,
    "lookback_counts": temporal.lookback_counts, "category_state": history.category_state, "co_occurrence": history.co_occurrence,
    "link_counts": paths.link_counts, "two_hop": paths.two_hop_features, "pivot_history": paths.pivot_history, "incoming_links": paths.incoming_link_counts,
}


def baseline_matrix(spec: TaskSpec, target: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Target columns plus point-in-time aggregates of the child table and the blocks of the spec."""
    block = temporal.point_in_time_features(
        target, tables[spec.child_table], row_key=spec.row_key, keys=[spec.target_key], target_time=spec.target_time,
        child_keys=[spec.child_key], child_time=spec.child_time, value=spec.value, prefix=spec.prefix, cutoff=spec.cutoff,
    )
    more = [BLOCKS[b["operator"]](target, *[tables[t] for t in b["tables"]], row_key=spec.row_key, **b["args"]) for b in spec.blocks]
    return assemble.assemble_blocks(target, [block, *more], spec.row_key)


def chosen_edges(spec: TaskSpec, train: DataFrame, tables: Mapping[str, DataFrame]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(fit rows, edges): dependencies scored on entity rows the training split may see."""
    entity = tables[spec.entity_table]
    fit = dependency.train_visible_rows(
        entity, train, entity_key=spec.entity_key, target_key=spec.target_key, entity_time=spec.entity_time,
        target_time=spec.target_time if spec.entity_time else None,
    )
    dependency.require_rows(fit)
    stats = dependency.pair_statistics(fit, list(spec.dependency_columns), exclude=[spec.label])
    text = [c for c, kind in fit.select(*spec.dependency_columns).dtypes if kind == "string" or kind.startswith("array")]
    edges = dependency.select_edges(
        stats, id_columns=[spec.entity_key, *spec.id_columns], label=spec.label, categorical_rhs=text, k=spec.max_edges, **spec.thresholds
    )
    return fit, [(r["lhs"], r["rhs"]) for r in edges.select("lhs", "rhs").collect()]


def compile_matrices(
    spec: TaskSpec, targets: Mapping[str, DataFrame], tables: Mapping[str, DataFrame]
) -> tuple[dict[str, DataFrame], dict[str, DataFrame], list[tuple[str, str]]]:
    """(baseline, candidate, edges) per split; without edges the candidate is the baseline itself."""
    baseline = {s: baseline_matrix(spec, t, tables) for s, t in targets.items()}
    if not spec.dependency_columns:
        return baseline, baseline, []
    fit, edges = chosen_edges(spec, targets["train"], tables)
    if not edges:
        return baseline, baseline, []
    candidate = {}
    for split, matrix in baseline.items():
        block = dependency.ambiguity_features(
            targets[split], tables[spec.entity_table], fit, edges, row_key=spec.row_key, target_key=spec.target_key,
            entity_key=spec.entity_key, entity_order=[a for a, _ in edges], entity_time=spec.entity_time,
            target_time=spec.target_time if spec.entity_time else None, cutoff=spec.cutoff,
        )
        candidate[split] = assemble.assemble_blocks(matrix, [block], spec.row_key)
    return baseline, candidate, edges


def feature_columns(spec: TaskSpec, matrix: DataFrame) -> list[str]:
    """Columns that are not keys, the cutoff, ids or the label and can be made numbers."""
    off = {*spec.row_key, spec.target_key, spec.target_time, spec.label, *spec.id_columns}
    return [c for c, kind in matrix.dtypes if c not in off and not kind.startswith(("array", "map", "struct", "binary"))]


def scoring_matrices(spec: TaskSpec, matrices: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """All features as numbers: texts by codes that the splits share, times as epoch seconds, truth values as 0/1."""
    kinds = dict(matrices["train"].select(*feature_columns(spec, matrices["train"])).dtypes)
    texts = [c for c, kind in kinds.items() if kind == "string"]
    times = [c for c, kind in kinds.items() if kind.startswith(("timestamp", "date"))]
    out = prepare.encode_jointly(list(matrices.values()), texts)
    times = {c: F.unix_seconds(F.col(c).cast("timestamp")).cast("double") for c in times}
    flags = {c: F.col(c).cast("int") for c, kind in kinds.items() if kind == "boolean"}
    decimals = {c: F.col(c).cast("double") for c, kind in kinds.items() if kind.startswith("decimal")}
    return {s: df.withColumns(times | flags | decimals) for s, df in zip(matrices, out, strict=True)}


def score_variants(
    spec: TaskSpec, variants: Mapping[str, Mapping[str, DataFrame]], seeds: Sequence[int] = SEEDS
) -> DataFrame:
    """Run table of every variant and seed; a seed fits on a hashed share of the training rows and is scored on all of ``val``."""
    parts = None
    for name, matrix in variants.items():
        matrix = scoring_matrices(spec, {s: matrix[s] for s in ("train", "val")})
        if spec.task == "multiclass":
            matrix["val"] = prepare.require_seen_classes(matrix["train"], matrix["val"], spec.label)
        for seed in seeds:
            kept = hash_int(key_text(spec.row_key, seed)) % 100 < spec.keep_percent
            pred = learn.score_matrix(
                matrix["train"].where(kept), matrix["val"], label=spec.label, features=feature_columns(spec, matrix["train"]),
                row_key=spec.row_key, task=spec.task, seed=seed,
            )
            if spec.task == "regression":
                m = metrics.regression_metrics(pred, "y_true", "y_score")
            elif spec.task == "multiclass":
                told = metrics.probability_metrics(pred, "y_true", "y_score").select(F.struct("log_loss", "mrr").alias("told")).scalar()
                m = metrics.multiclass_metrics(pred, "y_true", "y_pred").withColumn("told", told).select("*", "told.log_loss", "told.mrr").drop("told")
            else:
                m = metrics.binary_metrics(pred, "y_true", "y_score")
            one = m.select(
                F.lit(spec.name).alias("task"), F.lit(name).alias("variant"), F.lit(seed).cast("bigint").alias("seed"), "*"
            )
            parts = one if parts is None else parts.unionByName(one)
    return parts


def decide(spec: TaskSpec, runs: DataFrame) -> DataFrame:
    """Gate row of the task: the candidate must beat the baseline on every seed, by the spec's mode and metrics."""
    names = list(spec.gate_metrics) or [GATE_METRIC[spec.task][0]]
    up = [m not in SMALLER_IS_BETTER for m in names]
    paired = gate.pair_runs(runs, ["task"], "baseline", "candidate", names)
    pair = lambda m: (f"base_{m}", f"candidate_{m}")
    if spec.gate_mode == "lexicographic":
        return gate.lexicographic_gate(paired, ["task"], pair(names[0]), pair(names[1]), primary_up=up[0], secondary_up=up[1])
    if spec.gate_mode != "single":
        raise ValueError(f"unknown gate mode {spec.gate_mode!r}")
    return gate.single_gate(paired, ["task"], *pair(names[0]), maximise=up[0])


def require_all_seeds(runs: DataFrame, seeds: Sequence[int]) -> None:
    """An error unless every variant ran on exactly ``seeds``."""
    wrong = gate.require_seeds(runs, ["task", "variant"], seeds).first()
    if wrong is not None:
        raise ValueError(f"seeds of {wrong['variant']} are {wrong['seeds']}, not {sorted(seeds)}")


def predictions(spec: TaskSpec, matrices: Mapping[str, DataFrame], split: str = "val", seed: int = 41) -> DataFrame:
    """Row-aligned predictions for a split by a model of all training rows."""
    m = scoring_matrices(spec, {"train": matrices["train"], split: matrices[split]})
    return learn.score_matrix(m["train"], m[split], label=spec.label, features=feature_columns(spec, m["train"]), row_key=spec.row_key, task=spec.task, seed=seed)


def run_task(spark: SparkSession, spec: TaskSpec, targets: Mapping[str, DataFrame], tables: Mapping[str, DataFrame], seeds: Sequence[int] = SEEDS):
    """(chosen matrices per split, decision row, runs, edges).

    Matrices feed several fits, so their lineage is cut once in the shared checkpoint folder.
    """
    ensure_checkpoint_dir(spark)
    baseline, candidate, edges = compile_matrices(spec, targets, tables)
    same = not edges
    baseline = {s: m.checkpoint() for s, m in baseline.items()}
    if same:
        decision = spark.createDataFrame([(spec.name, "FALLBACK")], "task string, outcome string")
        return baseline, decision.first(), None, []
    candidate = {s: m.checkpoint() for s, m in candidate.items()}
    runs = score_variants(spec, {"baseline": baseline, "candidate": candidate}, seeds).checkpoint()
    require_all_seeds(runs, seeds)
    decision = decide(spec, runs).first()
    chosen = {s: assemble.apply_decision(decision["outcome"], baseline[s], candidate[s]) for s in baseline}
    return chosen, decision, runs, edges
