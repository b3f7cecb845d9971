"""Scoring and ranking candidate features: supervised, heuristic, label-free, and ranking quality.

Tables with one row per feature are small by construction; the passes that build them are not and
stay grouped by (feature, value).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.columns import number
from tidemark.operators.metrics import ranking_aggregates, with_counts_above
from tidemark.operators.scan import BY_SIZE, bounded, numbered, prefix_scan, value_counts


def ranked(df: DataFrame, order: Sequence[Column], k: int | None = None, groups: Sequence[str] = ()) -> DataFrame:
    """Add ``rank`` and, with ``k``, ``selected``. For tables with one row per candidate."""
    out = df.withColumn("rank", F.row_number().over(W.partitionBy(*groups).orderBy(*order)))
    return out if k is None else out.withColumn("selected", F.col("rank") <= k)


def feature_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per feature: rows, non-null rate, distinct values and their share, sample std, mean of absolutes."""
    wide = df.select(*[number(c).alias(c) for c in columns]).agg(
        F.count("*").alias("n"),
        *[F.count(c).alias(f"k_{i}") for i, c in enumerate(columns)],
        *[F.stddev_samp(c).alias(f"s_{i}") for i, c in enumerate(columns)],
        *[F.avg(F.abs(c)).alias(f"a_{i}") for i, c in enumerate(columns)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"), F.col("n").alias("n_rows"), (F.col(f"k_{i}") / F.col("n")).alias("nonnull_rate"),
                F.col(f"s_{i}").alias("std"), F.col(f"a_{i}").alias("mean_abs"),
            )
            for i, c in enumerate(columns)
        ]
    )
    base = wide.select(F.explode(rows).alias("r")).select("r.*")
    distinct = value_counts(df, columns).groupBy("feature").agg(F.count("*").alias("n_distinct"))
    out = base.join(bounded(distinct, len(columns)), "feature", "left")
    n = F.coalesce("n_distinct", F.lit(0).cast("bigint"))
    return out.withColumn("n_distinct", n).withColumn("distinct_ratio", n / F.greatest("n_rows", F.lit(1)))


def unsupervised_scores(profile: DataFrame, id_like: Sequence[str] = ()) -> DataFrame:
    """Coverage plus damped cardinality minus a constant penalty, in both published weightings."""
    n = F.col("n_distinct")
    flat = F.when(n <= 1, 0.5).otherwise(0.0)
    share = F.log1p(n.cast("double")) / F.log1p(F.greatest(F.col("n_rows"), F.lit(2)).cast("double"))
    ident = F.when(F.col("feature").isin(list(id_like)), 0.5).otherwise(0.0) if id_like else F.lit(0.0)
    return profile.select(
        "*",
        (F.col("nonnull_rate") + 0.1 * F.log1p(n.cast("double")) - flat).alias("score_log"),
        (F.col("nonnull_rate") + 0.25 * share - ident - flat).alias("score_share"),
    )


NEIGHBOURS = 3
BLOCK_ROWS = 1_000_000  # neighbouring values looked at by one window; its edges are lent to the blocks beside it
INSIDE = 1 - 1e-9  # of a radius: a value at the radius itself, rounding included, is outside


def digamma(n: Column) -> Column:
    """Digamma of a positive whole number: six steps of its recurrence, then the asymptotic series, right to 1e-12."""
    n = n.cast("double")
    x = n + 6
    inverse = 1 / (x * x)
    tail = inverse * (F.lit(1 / 12) - inverse * (F.lit(1 / 120) - inverse * (F.lit(1 / 252) - inverse * (F.lit(1 / 240) - inverse / 132))))
    return F.ln(x) - 0.5 / x - tail - sum((1 / (n + j) for j in range(6)), F.lit(0.0))


def neighbour_information(
    rows: DataFrame, features: Sequence[str], label: str, *, neighbours: int = NEIGHBOURS, splits: int = BY_SIZE, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(feature, mi): nearest-neighbour mutual information, in nats, of each number with a class label.

    For a row with N_c rows in its class, k = min(neighbours, N_c - 1), r the distance to its k-th nearest row of that class
    and m the rows of all classes nearer than r (with r = 0, those at its own value), itself included,
    mi = psi(N) + mean psi(k) - mean psi(N_c) - mean psi(m), at least 0. Rows alone in their class take no part; a feature
    without other rows has no mi. Missing features and labels must be filled or dropped before.

    Equal values are one row with a count. The k values on either side are found by ordered windows over numbered blocks
    that overlap by k; ranks within the radius are running counts read at its two ends, from slices of the value order.
    """
    long = rows.unpivot([label], list(features), "feature", "v")
    counts = long.groupBy("feature", F.col(label).alias("c"), "v").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("feature", "c").agg(F.sum("n").alias("n_c"))
    counts = counts.join(sizes.where("n_c > 1"), ["feature", "c"])
    placed = numbered(counts, ["feature", "c"], ["v"], "i", splits=splits)
    block, inside = F.expr(f"i div {block_rows}"), F.col("i") % block_rows
    lent = F.array(block, F.when(inside < neighbours, block - 1), F.when(inside >= block_rows - neighbours, block + 1))
    spread = placed.select("*", F.explode(F.array_compact(lent)).alias("b"))
    w = W.partitionBy("feature", "c", "b").orderBy("v")
    beside = [step(F.struct("v", "n"), j).over(w) for step in (F.lag, F.lead) for j in range(1, neighbours + 1)]
    near = spread.select("*", F.array_compact(F.array(*beside)).alias("near")).where(F.col("b") == block)
    k = F.least(F.lit(neighbours), F.col("n_c") - 1)
    apart = F.array_sort(F.concat(
        F.array(F.struct(F.lit(0.0).alias("d"), (F.col("n") - 1).alias("n"))), F.transform("near", lambda s: F.struct(F.abs(s["v"] - F.col("v")).alias("d"), s["n"].alias("n")))
    ))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("r"))
    radius = F.aggregate(apart, start, lambda s, x: F.struct((s["n"] + x["n"]).alias("n"), F.coalesce(s["r"], F.when(s["n"] + x["n"] >= k, x["d"])).alias("r")))["r"]
    known = near.select("feature", "c", "v", "n", "n_c", k.alias("k"), radius.alias("r"))
    # running counts at the ends of the radius: at one value, upper ends come first, then values, then lower ends
    reach = F.col("r") * INSIDE
    tied = F.col("r") == 0
    ends = known.select(
        "feature", "c", "v", "n", "n_c", "k",
        F.explode(F.array(
            F.struct(F.when(tied, F.col("v")).otherwise(F.col("v") + reach).alias("at"), F.when(tied, 2).otherwise(0).alias("side"), F.lit(1).alias("sign")),
            F.struct(F.when(tied, F.col("v")).otherwise(F.col("v") - reach).alias("at"), F.when(tied, 0).otherwise(2).alias("side"), F.lit(-1).alias("sign")),
        )).alias("e"),
    )
    values = counts.groupBy("feature", "v").agg(F.sum("n").alias("x")).select("feature", F.struct(F.col("v").alias("at"), F.lit(1).alias("side")).alias("o"), "x")
    asked = ends.select("feature", F.struct("e.at", "e.side").alias("o"), F.struct("c", "v", "n", "n_c", "k", "e.sign").alias("who"))
    stream = values.withColumn("who", F.lit(None).cast(asked.schema["who"].dataType)).unionByName(asked.withColumn("x", F.lit(0).cast("bigint")))
    upto = prefix_scan(stream, ["feature"], "o", adds=["x"], splits=splits, marks_from=values)
    found = upto.where("who is not null").groupBy("feature", "who.c", "who.v", "who.n", "who.n_c", "who.k").agg(F.sum(F.col("who.sign") * F.col("x")).alias("m"))
    total = F.sum("n")
    mean = lambda e: F.sum(F.col("n") * e) / total
    mi = digamma(total) + mean(digamma(F.col("k"))) - mean(digamma(F.col("n_c"))) - mean(digamma(F.col("m")))
    return found.groupBy("feature").agg(F.greatest(mi, F.lit(0.0)).alias("mi"))


def supervised_scores(df: DataFrame, features: Sequence[str], label: str, *, bins: int = 10, splits: int = BY_SIZE) -> DataFrame:
    """ROC-AUC, oriented AUC, average precision and mutual information of every feature.

    Missing values count as 0. Mutual information (nats) is that of nearest neighbours (``neighbour_information``) and, beside
    it, that of equal-count bins of the score order, ties kept together. Constant features score -1.
    """
    y = F.col(label)
    rows = df.where(y.isNotNull()).select(y.alias("__y"), *[F.coalesce(number(c), F.lit(0.0)).alias(c) for c in features])
    long = rows.unpivot(["__y"], list(features), "feature", "__s")
    counts = long.groupBy("feature", "__s").agg(
        F.count_if(F.col("__y") == 1).alias("pos"), F.count_if(F.col("__y") != 1).alias("neg")
    )
    above = with_counts_above(counts, ["feature"], splits, long.select("feature", "__s"))
    size = rows.agg(F.count("*").alias("n")).scalar()
    here = F.col("pos") + F.col("neg")
    above = above.withColumn("__n", size)
    before = F.col("ge_pos") + F.col("ge_neg") - here
    cells = above.withColumn("__bin", F.floor(before * bins / F.col("__n"))).groupBy("feature", "__bin").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )

    def xl(x: Column) -> Column:
        x = x.cast("double")
        return F.when(x > 0, x * F.ln(x)).otherwise(0.0)

    # I = ln N + (sum n_by ln n_by - sum n_b ln n_b - sum n_y ln n_y) / N
    info = cells.groupBy("feature").agg(
        (
            F.ln(F.sum(F.col("pos") + F.col("neg")))
            + (
                F.sum(xl(F.col("pos")) + xl(F.col("neg")) - xl(F.col("pos") + F.col("neg")))
                - xl(F.sum("pos")) - xl(F.sum("neg"))
            ) / F.sum(F.col("pos") + F.col("neg"))
        ).alias("mi_binned")
    )
    ranks = ranking_aggregates(F.col("ge_pos"), F.col("ge_neg"))
    main = above.groupBy("feature").agg(F.count("*").alias("nunique"), *[e.alias(k) for k, e in ranks.items()])
    near = neighbour_information(rows.withColumn("__y", F.col("__y") == 1), features, "__y", splits=splits)
    out = main.join(bounded(info, len(features)), "feature").join(bounded(near, len(features)), "feature", "left")
    live = F.col("nunique") > 1
    return out.select(
        "feature", "nunique",
        F.when(live, F.col("roc_auc")).alias("roc_auc"),
        F.when(live, F.greatest(F.col("roc_auc"), 1 - F.col("roc_auc"))).alias("roc_auc_oriented"),
        F.when(live, F.col("average_precision")).alias("average_precision"),
        F.when(live, F.col("mi")).alias("mi"),
        F.when(live, F.greatest("mi_binned", F.lit(0.0))).alias("mi_binned"),
        F.when(live, F.coalesce(2 * F.abs(F.col("roc_auc") - 0.5), F.lit(-1.0))).otherwise(-1.0).alias("score_auc"),
        F.when(live, F.coalesce("average_precision", F.lit(-1.0))).otherwise(-1.0).alias("score_ap"),
        F.when(live, F.coalesce("mi", F.lit(-1.0))).otherwise(-1.0).alias("score_mi"),
    )


TIE_COLUMNS = {
    "auc": ["score_auc", "roc_auc_oriented", "average_precision", "mi", "nunique"],
    "ap": ["score_ap", "roc_auc_oriented", "mi", "nunique"],
    "mi": ["score_mi", "roc_auc_oriented", "average_precision", "nunique"],
}


def rank_supervised(scores: DataFrame, metric: str, k: int) -> DataFrame:
    return ranked(scores, [*[F.desc_nulls_last(c) for c in TIE_COLUMNS[metric]], F.col("feature")], k)


def first_match(text: Column, rules: Sequence[tuple[str, str, object]], otherwise: object) -> Column:
    """Value of the first rule (kind, needle, value) whose needle occurs in ``text``."""
    test = {"prefix": text.startswith, "suffix": text.endswith, "part": text.contains}
    out = None
    for kind, needle, value in rules:
        hit = test[kind](needle)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return F.lit(otherwise) if out is None else out.otherwise(F.lit(otherwise))


# Aggregator and cost of a feature by its name, and block weights of the heuristic score.
AGGREGATOR_RULES = [
    ("suffix", "__is_missing", "missing_indicator"), ("part", "count", "count"), ("part", "mean", "mean"),
    ("part", "std", "std"), ("part", "max", "max"), ("part", "days_since_last", "last_delta"),
    ("part", "majconf", "majority_confidence"), ("part", "entropy", "entropy"),
]
COST_RULES = [
    ("suffix", "__is_missing", 0.05), ("part", "days_since_last", 0.50), ("part", "std", 0.35), ("part", "mean", 0.30),
    ("part", "max", 0.30), ("part", "count", 0.20), ("prefix", "f_amb__", 0.20),
]
STATISTIC_SUFFIX = "__(majconf|entropy|conflict_count|support_count)(__is_missing)?$"
BLOCKS = "block string, reliability double, path_length double"
BLOCK_WEIGHTS = [("aggregation", 1.0, 1.0), ("temporal_aggregation", 1.0, 1.0), ("ambiguity", 0.7, 1.0), ("target_original", 0.8, 0.0)]


def heuristic_scores(profile: DataFrame, aggregate_prefix: str, edges: DataFrame | None = None) -> DataFrame:
    """Name-and-coverage score: reliability, coverage and ambiguity bonus against uniqueness, path and cost.

    ``edges(feature_stem, edge_weight, lhs_uniqueness)`` describes the dependency behind a feature.
    """
    spark = profile.sparkSession
    name = F.col("feature")
    block = first_match(
        name,
        [("prefix", "f_amb__", "ambiguity"), ("part", "days_since_last", "temporal_aggregation"), ("prefix", aggregate_prefix, "aggregation")],
        "target_original",
    )
    flag = name.endswith("__is_missing")
    weights = F.broadcast(spark.createDataFrame(BLOCK_WEIGHTS, BLOCKS))
    rows = profile.withColumn("block", block).join(weights, "block")
    if edges is not None:
        rows = rows.withColumn("feature_stem", F.regexp_replace(name, STATISTIC_SUFFIX, "")).join(edges, "feature_stem", "left").drop("feature_stem")
    else:
        rows = rows.withColumn("edge_weight", F.lit(None).cast("double")).withColumn("lhs_uniqueness", F.lit(None).cast("double"))
    amb = F.col("block") == "ambiguity"
    reliability = F.when(amb, F.coalesce("edge_weight", "reliability")).otherwise(F.col("reliability"))
    bonus = F.when(amb & ~flag, 0.5).when(amb, 0.1).otherwise(0.0)
    unique = F.when(amb, 0.7 * F.coalesce("lhs_uniqueness", F.lit(0.0))).otherwise(0.0)
    cost = first_match(name, COST_RULES, 0.10)
    score = (
        1.5 * reliability + 0.8 * F.log1p(F.greatest("nonnull_rate", F.lit(0.0))) + bonus - unique
        - 0.2 * F.col("path_length") - 0.3 * cost - F.when(flag, 0.15).otherwise(0.0)
    )
    return rows.select(
        "feature", "block", first_match(name, AGGREGATOR_RULES, "unknown").alias("aggregator"), "nonnull_rate",
        reliability.alias("reliability"), unique.alias("uniqueness_penalty"), cost.alias("cost"), score.alias("heuristic_score"),
    )


def label_free_scores(profile: DataFrame, rules: Sequence[tuple[str, float]]) -> DataFrame:
    """Sum of name-pattern weights, coverage and a cardinality band, less 0.02 per name part.

    ``rules`` are (regular expression on the lower-case name, weight) pairs; every matching rule counts.
    """
    low, n = F.lower("feature"), F.col("n_distinct")
    named = sum((F.when(low.rlike(p), F.lit(w)).otherwise(0.0) for p, w in rules), F.lit(0.0))
    band = F.when(n <= 1, -2.0).when(n <= 500, 0.7).when(n <= 5000, 0.2).otherwise(-0.5)
    parts = F.size(F.split("feature", "_"))
    return profile.select(
        "feature", "nonnull_rate", "n_distinct", (named + F.col("nonnull_rate") + band - 0.02 * parts).alias("label_free_score")
    )


def edge_quality(edges: DataFrame, score: str, truth: str, kind: str, ks: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Quality of a ranked edge list: AUROC, AP, and at each K true positives, precision, recall, kind rates.

    ``kind`` marks spurious edges as ``surrogate`` or ``constant``. One row per candidate edge: small.
    """
    counts = edges.groupBy(*by, F.col(score).alias("__s")).agg(
        F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) != 1).alias("neg")
    )
    ranks = ranking_aggregates(F.col("ge_pos"), F.col("ge_neg"))
    area = with_counts_above(counts, by, splits=1).groupBy(*by).agg(*[e.alias(k) for k, e in ranks.items()])
    order = [F.desc(score), F.col("lhs"), F.col("rhs")]
    placed = ranked(edges, order, groups=by)
    aggs = []
    for k in ks:
        top = F.col("rank") <= k
        size = F.count_if(top)
        tp = F.count_if(top & (F.col(truth) == 1))
        aggs += [
            tp.alias(f"tp_at_{k}"), (tp / size).alias(f"precision_at_{k}"),
            (tp / F.greatest(F.count_if(F.col(truth) == 1), F.lit(1))).alias(f"recall_at_{k}"),
            (F.count_if(top & (F.col(kind) == "surrogate")) / size).alias(f"surrogate_rate_at_{k}"),
            (F.count_if(top & (F.col(kind) == "constant")) / size).alias(f"constant_rate_at_{k}"),
        ]
    at_k = placed.groupBy(*by).agg(*aggs)
    if by:
        return area.join(at_k, list(by))
    return at_k.withColumn("__a", area.select(F.struct("*").alias("a")).scalar()).select("__a.*", *at_k.columns)


def program_recall(ranking: DataFrame, truth: DataFrame, ks: Sequence[int], by: Sequence[str]) -> DataFrame:
    """Per group and K: known programs recovered and missed, and recall. ``ranking`` has feature and rank."""
    known = truth.join(ranking.select(*by, "feature", "rank"), [*by, "feature"], "left")
    out = []
    for k in ks:
        hit = F.col("rank") <= k
        out.append(
            known.groupBy(*by).agg(
                F.lit(k).alias("k"),
                F.concat_ws(",", F.sort_array(F.collect_list(F.when(hit, F.col("feature"))))).alias("recovered"),
                F.concat_ws(",", F.sort_array(F.collect_list(F.when(~F.coalesce(hit, F.lit(False)), F.col("feature"))))).alias("missing"),
                (F.count_if(hit) / F.count("*")).alias("recall"),
            )
        )
    return reduce(lambda a, b: a.unionByName(b), out)


def oracle_gap(results: DataFrame, metric: str, method: str, oracle: str, by: Sequence[str]) -> DataFrame:
    """Metric of every method minus the oracle's in its group, and the mean per method."""
    best = results.where(F.col(method) == oracle).groupBy(*by).agg(F.max(metric).alias("oracle_value"))
    gaps = results.join(best, list(by)).withColumn("gap", F.col(metric) - F.col("oracle_value"))
    return gaps.groupBy(method).agg(
        F.count("*").alias("n_runs"), F.avg(metric).alias(f"{metric}_mean"), F.avg("gap").alias("gap_mean"),
        F.min("gap").alias("gap_min"),
    )


def rule_features(profile: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """Profile plus 0/1 rule columns, the input of a learned feature ranker."""
    return profile.select("*", *[c.cast("int").alias(n) for n, c in flags.items()])
