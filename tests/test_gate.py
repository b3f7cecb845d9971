import math

import pytest

from tidemark.operators import assemble, gate


def paired(spark, base, cand, base2=None, cand2=None):
    base2, cand2 = base2 or [0.0] * len(base), cand2 or [0.0] * len(base)
    rows = [("d", 41 + i, *map(float, r)) for i, r in enumerate(zip(base, cand, base2, cand2, strict=True))]
    return spark.createDataFrame(rows, "task string, seed bigint, b double, c double, b2 double, c2 double")


def single(spark, base, cand, **how):
    return gate.single_gate(paired(spark, base, cand), ["task"], "b", "c", **how).first()["outcome"]


@pytest.mark.parametrize(
    ("base", "cand", "how", "want"),
    [
        ([0.55, 0.4, 0.61], [0.57, 0.45, 0.62], {}, "SELECT"),
        ([0.31, 0.36, 0.3], [0.5, 0.35, 0.5], {}, "FALLBACK"),
        ([8.0, 7.5, 9.25], [7.0, 7.25, 9.0], {"maximise": False}, "SELECT"),
        ([3.0, 2.5], [2.0, 2.5], {"maximise": False}, "FALLBACK"),
        ([0.25, 0.5], [0.5, 0.75], {"min_improvement": 0.25}, "FALLBACK"),
        ([0.2, 0.3], [0.2 + 5e-13, 0.9], {}, "FALLBACK"),
    ],
)
def test_single(spark, base, cand, how, want):
    assert single(spark, base, cand, **how) == want


def test_non_finite_is_an_error(spark):
    with pytest.raises(Exception, match="finite"):
        single(spark, [math.nan, 0.7], [0.8, 0.8])


@pytest.mark.parametrize(
    ("b", "c", "b2", "c2", "up2", "want"),
    [
        ([0.7, 0.7], [0.8, 0.8], [0.5, 0.5], [0.4, 0.4], True, "SELECT"),
        ([0.7, 0.7], [0.7, 0.7], [0.5, 0.5], [0.6, 0.6], True, "SELECT"),
        ([0.7, 0.7], [0.7, 0.7], [0.5, 0.5], [0.5, 0.5], True, "FALLBACK"),
        ([0.7, 0.7], [0.6, 0.8], [0.5, 0.5], [0.9, 0.9], True, "FALLBACK"),
        ([0.7, 0.7], [0.7, 0.7], [0.5, 0.5], [0.4, 0.4], False, "SELECT"),
    ],
)
def test_lexicographic(spark, b, c, b2, c2, up2, want):
    out = gate.lexicographic_gate(paired(spark, b, c, b2, c2), ["task"], ("b", "c"), ("b2", "c2"), secondary_up=up2)
    assert out.first()["outcome"] == want


def test_unpaired_seed_is_an_error(spark):
    runs = spark.createDataFrame([("t", "a", 41, 0.1), ("t", "b", 41, 0.2), ("t", "a", 42, 0.1)], "task string, variant string, seed bigint, m double")
    with pytest.raises(Exception, match="without exactly one"):
        gate.pair_runs(runs, ["task"], "a", "b", ["m"]).collect()


def test_fallback_returns_the_untouched_baseline(spark):
    a, b = spark.range(3), spark.range(3).selectExpr("id", "id * 2 as extra")
    assert assemble.apply_decision("FALLBACK", a, b) is a
    assert assemble.apply_decision("SELECT", a, b) is b
    with pytest.raises(ValueError, match="unknown outcome"):
        assemble.apply_decision("maybe", a, b)


@pytest.mark.parametrize("extra", [("d", "a", 1, 0.9), ("d", "b", 1, 0.9)])
def test_repeated_run_is_an_error_for_every_reader(spark, extra):
    runs = spark.createDataFrame([("d", "a", 1, 0.4), ("d", "b", 1, 0.5), extra], "task string, variant string, seed bigint, m double")
    pairs = gate.pair_runs(runs, ["task"], "a", "b", ["m"])
    with pytest.raises(Exception, match="exactly one"):
        gate.single_gate(pairs, ["task"], "base_m", "candidate_m").collect()
    with pytest.raises(Exception, match="exactly one"):
        pairs.select("base_m").collect()
