"""Paired-seed validation gate: keep a candidate only if it wins on every seed, else fall back exactly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOL = 1e-12


def close(a: Column, b: Column | float, tol: float = TOL) -> Column:
    """Equal within a relative or absolute tolerance."""
    b = b if isinstance(b, Column) else F.lit(float(b))
    return F.abs(a - b) <= F.greatest(F.lit(tol) * F.greatest(F.abs(a), F.abs(b)), F.lit(tol))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def checked(c: Column, what: str) -> Column:
    """The score itself; a missing or non-finite one is an error."""
    return F.when(finite(c), c).otherwise(F.raise_error(F.lit(f"{what} scores must be finite")).cast("double"))


def pair_runs(runs: DataFrame, task: Sequence[str], base: str, candidate: str, metrics: Sequence[str]) -> DataFrame:
    """One row per task and seed with ``base_<m>`` and ``candidate_<m>``; an unpaired seed is an error."""
    picked = runs.where(F.col("variant").isin(base, candidate))
    is_base, is_cand = F.col("variant") == base, F.col("variant") == candidate
    fine = (F.count_if(is_base) == 1) & (F.count_if(is_cand) == 1)
    told = F.concat(F.lit("seed without exactly one baseline and one candidate run: "), F.coalesce(F.col("seed").cast("string"), F.lit("NULL")))

    def only(side: Column, m: str) -> Column:
        # the check sits in every score, so no reader of a score can prune it
        return F.when(fine, F.max(F.when(side, F.col(m)))).otherwise(F.raise_error(told).cast(runs.schema[m].dataType))

    return picked.groupBy(*task, "seed").agg(
        *[only(is_base, m).alias(f"base_{m}") for m in metrics], *[only(is_cand, m).alias(f"candidate_{m}") for m in metrics],
    )


def gain(base: Column, candidate: Column, maximise: Column | bool) -> Column:
    up = maximise if isinstance(maximise, Column) else F.lit(maximise)
    return F.when(up, candidate - base).otherwise(base - candidate)


def single_gate(
    paired: DataFrame, task: Sequence[str], base: str, candidate: str, *, maximise: Column | bool = True, min_improvement: float = 0.0
) -> DataFrame:
    """Per task: SELECT if every seed gains more than ``min_improvement`` (a tie fails), else FALLBACK."""
    g = gain(checked(F.col(base), "baseline"), checked(F.col(candidate), "candidate"), maximise)
    rows = paired.withColumn("gain", g)
    ok = (F.col("gain") > min_improvement) & ~close(F.col("gain"), min_improvement)
    return rows.groupBy(*task).agg(
        F.count("*").alias("n_seeds"), F.avg("gain").alias("mean_gain"), F.min("gain").alias("min_gain"),
        F.bool_and(ok).alias("all_seeds_pass"),
    ).withColumn("outcome", F.when(F.col("all_seeds_pass"), "SELECT").otherwise("FALLBACK"))


def lexicographic_seed_rows(
    paired: DataFrame, primary: tuple[str, str], secondary: tuple[str, str], *, primary_up: Column | bool = True,
    secondary_up: Column | bool = True, tolerance: float = TOL,
) -> DataFrame:
    """Add both gains and ``seed_pass``: the primary improves, or ties while the secondary improves."""
    g1 = gain(checked(F.col(primary[0]), "baseline"), checked(F.col(primary[1]), "candidate"), primary_up)
    g2 = gain(checked(F.col(secondary[0]), "baseline"), checked(F.col(secondary[1]), "candidate"), secondary_up)
    rows = paired.withColumn("primary_gain", g1).withColumn("secondary_gain", g2)
    tied = F.abs(F.col("primary_gain")) <= tolerance
    passed = (F.col("primary_gain") > tolerance) | (tied & (F.col("secondary_gain") > tolerance))
    return rows.withColumn("seed_pass", passed)


def lexicographic_gate(paired: DataFrame, task: Sequence[str], primary: tuple[str, str], secondary: tuple[str, str], **how) -> DataFrame:
    rows = lexicographic_seed_rows(paired, primary, secondary, **how)
    return rows.groupBy(*task).agg(
        F.count("*").alias("n_seeds"), F.avg("primary_gain").alias("mean_primary_gain"),
        F.avg("secondary_gain").alias("mean_secondary_gain"), F.bool_and("seed_pass").alias("all_seeds_pass"),
    ).withColumn("outcome", F.when(F.col("all_seeds_pass"), "SELECT").otherwise("FALLBACK"))


def require_seeds(paired: DataFrame, task: Sequence[str], seeds: Sequence[int]) -> DataFrame:
    """Tasks whose seed set is not exactly ``seeds`` (should be empty)."""
    got = paired.groupBy(*task).agg(F.sort_array(F.collect_set(F.col("seed").cast("bigint"))).alias("seeds"))
    want = F.array(*[F.lit(s).cast("bigint") for s in sorted(seeds)])
    wrong = got.where(F.col("seeds") != want)
    return wrong.withColumn("seeds", F.array_join(F.transform("seeds", lambda s: s.cast("string")), ","))


def gate_report(paired: DataFrame, decisions: DataFrame, task: Sequence[str], metric: str, base: str, candidate: str, maximise: bool = True) -> DataFrame:
    """Per task and seed: scores, improvement, outcome, and what is used after gating."""
    b, c = F.col(f"base_{metric}"), F.col(f"candidate_{metric}")
    chosen = F.col("outcome") == "SELECT"
    rows = paired.join(decisions.select(*task, "outcome"), list(task))
    return rows.select(
        *task, "seed", b.alias("base_score"), c.alias("candidate_score"), gain(b, c, maximise).alias("improvement"), "outcome",
        F.when(chosen, F.lit(candidate)).otherwise(F.lit(base)).alias("selected_variant"),
        F.when(chosen, c).otherwise(b).alias("selected_score"),
        (~chosen).alias("fallback_exact_match"),
    )


def override_decisions(archive: DataFrame, runtime: DataFrame, task: Sequence[str]) -> DataFrame:
    """Archived gate rows with recomputed decisions on top; a fallback gains exactly 0.

    Both tables have task keys, ``gate_outcome``, ``base_score``, ``candidate_score``.
    """
    new = runtime.select(*task, *[F.col(c).alias(f"__{c}") for c in ("gate_outcome", "base_score", "candidate_score")])
    j = archive.join(new, list(task), "left")
    outcome = F.coalesce("__gate_outcome", "gate_outcome")
    b, c = F.coalesce("__base_score", "base_score"), F.coalesce("__candidate_score", "candidate_score")
    picked = F.when(outcome == "SELECT", c).otherwise(b)
    return j.select(
        *task, outcome.alias("gate_outcome"), b.alias("base_score"), c.alias("candidate_score"),
        picked.alias("selected_score"), (picked - b).alias("selected_gain"), F.col("__gate_outcome").isNotNull().alias("recomputed"),
    )


def strict_audit(seed_rows: DataFrame, archive: DataFrame, task: Sequence[str]) -> DataFrame:
    """Recomputed decision per task next to the archived one, with the reason of a fallback.

    ``seed_rows`` has gate_mode, primary_gain, secondary_gain and seed_pass per seed.
    """
    ordered = F.sort_array(F.collect_list(F.struct("seed", F.round("primary_gain", 12).alias("g"))))
    per_task = seed_rows.groupBy(*task).agg(
        F.first("gate_mode").alias("gate_mode"), F.bool_and("seed_pass").alias("all_seeds_pass"),
        F.avg("primary_gain").alias("mean_primary_gain"), F.array_size(ordered).alias("n_seeds"),
        F.sum(F.when(F.col("seed_pass"), 0).otherwise(1)).alias("failed_seeds"),
    )
    strict = F.when(F.col("all_seeds_pass"), "SELECT").otherwise("FALLBACK")
    reason = (
        F.when(F.col("all_seeds_pass"), "all_seeds_strictly_pass")
        .when(F.col("gate_mode") == "lexicographic", "lexicographic_seed_inconsistency_fallback")
        .otherwise("primary_metric_seed_inconsistency_fallback")
    )
    out = per_task.join(archive.select(*task, F.col("gate_outcome").alias("legacy_gate")), list(task), "left")
    return out.withColumn("strict_gate", strict).withColumn("gate_reason", reason).withColumn(
        "gate_matches_legacy", F.col("strict_gate").eqNullSafe(F.col("legacy_gate"))
    )


def reconcile(audit: DataFrame, special: DataFrame, task: Sequence[str]) -> DataFrame:
    """Class of every archived-versus-recomputed difference and the decision to report.

    ``special(task.., mismatch_class, recommended_gate)`` lists known exceptions; agreement needs none,
    any other difference is ``unexplained``.
    """
    j = audit.join(special, list(task), "left")
    kind = (
        F.when(F.col("mismatch_class").isNotNull(), F.col("mismatch_class"))
        .when(F.col("gate_matches_legacy"), "agreement").otherwise("unexplained")
    )
    return j.select(
        *task, "legacy_gate", "strict_gate", kind.alias("mismatch_class"),
        F.coalesce("recommended_gate", "strict_gate").alias("recommended_gate"), "gate_reason",
    )


def metric_coverage(runs: DataFrame, task: Sequence[str], variants: Sequence[str], metrics: Sequence[str], seeds: Sequence[int]) -> DataFrame:
    """Per task: seeds present per variant and the metrics complete for every variant and seed."""
    rows = runs.where(F.col("variant").isin(list(variants)) & F.col("seed").isin(list(seeds)))
    need = len(variants) * len(seeds)
    cells = rows.groupBy(*task, "variant", "seed").agg(*[F.max(finite(F.col(m)).cast("int")).alias(m) for m in metrics])
    return cells.groupBy(*task).agg(
        *[F.count_if(F.col("variant") == v).alias(f"seeds_{v}") for v in variants],
        F.concat_ws(",", *[F.when(F.sum(m) == need, F.lit(m)) for m in metrics]).alias("complete_metrics"),
    )


def provenance(inventory: DataFrame, audit: DataFrame, reconciled: DataFrame, task: Sequence[str]) -> DataFrame:
    """Inventory with the final gate and where it comes from, by precedence."""
    j = inventory.join(audit.select(*task, "strict_gate"), list(task), "left").join(
        reconciled.select(*task, "recommended_gate", "mismatch_class"), list(task), "left"
    )
    source = (
        F.when(F.col("mismatch_class").isNotNull() & (F.col("mismatch_class") != "agreement"), "reconciled")
        .when(F.col("strict_gate").isNotNull(), "strict_audit").otherwise("archive")
    )
    return j.withColumn("final_gate", F.coalesce("recommended_gate", "strict_gate", "gate_outcome")).withColumn("provenance", source)
