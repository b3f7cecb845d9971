"""MLlib seam: score a feature matrix, calibrate dependency statistics, rank feature programs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.columns import number, poisson_weights
from tidemark.operators.metrics import binary_metrics, ranking_aggregates
from tidemark.operators.prepare import impute, varying_columns
from tidemark.operators.rank import ranked
from tidemark.operators.scan import BY_SIZE, prefix_scan


def score_matrix(
    train: DataFrame, val: DataFrame, *, label: str, features: Sequence[str], row_key: Sequence[str], task: str = "binary", seed: int = 41
) -> DataFrame:
    """Train on ``train`` and return predictions for ``val``: row_key, y_true, y_score (and y_pred).

    Constant columns are dropped and gaps filled with train medians first. Tasks: binary (boosted
    trees), logistic, multiclass (random forest), regression (boosted trees).
    """
    cols = varying_columns(train, features)
    a, b = impute(train.where(F.col(label).isNotNull()), [train.where(F.col(label).isNotNull()), val], cols, [])
    models = {
        "binary": lambda: GBTClassifier(labelCol="__y", featuresCol="__x", maxIter=10, maxDepth=4, seed=seed),
        "logistic": lambda: LogisticRegression(labelCol="__y", featuresCol="__x", maxIter=50),
        "multiclass": lambda: RandomForestClassifier(labelCol="__y", featuresCol="__x", numTrees=20, seed=seed),
        "regression": lambda: GBTRegressor(labelCol="__y", featuresCol="__x", maxIter=10, maxDepth=4, seed=seed),
    }
    pipe = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="__x", handleInvalid="keep"), models[task]()])
    ready = lambda d: d.withColumn("__y", F.col(label).cast("double"))
    model = pipe.fit(ready(a).select("__y", *cols))
    out = model.transform(ready(b))
    keep = [*row_key, F.col("__y").alias("y_true")]
    if task == "regression":
        return out.select(*keep, F.col("prediction").alias("y_score"))
    p = vector_to_array("probability")
    score = p if task == "multiclass" else F.get(p, F.lit(1))
    return out.select(*keep, F.col("prediction").alias("y_pred"), score.alias("y_score"))


# Statistics the dependency calibrator reads.
CALIBRATOR_FEATURES = [
    "r_pair", "r_tuple", "r_del", "r_ent", "lhs_collision_rate", "lhs_uniqueness", "lhs_support_repeated", "coverage",
    "rhs_entropy", "lhs_arity", "schema_flag", "bootstrap_stability",
]


def calibrate_dependencies(
    stats: DataFrame, label: str, features: Sequence[str] = tuple(CALIBRATOR_FEATURES), score: DataFrame | None = None
) -> DataFrame:
    """Probability that a dependency is meaningful: balanced, standardised logistic regression.

    Fitted on ``stats``; the rows of ``score`` come back (those of ``stats`` itself if it is absent).
    """
    share = stats.agg(F.avg(F.col(label).cast("double"))).first()[0]
    if not share or share == 1.0:
        raise ValueError("calibration needs both classes")
    weight = F.when(F.col(label) == 1, 0.5 / share).otherwise(0.5 / (1 - share))
    named = [F.coalesce(number(c), F.lit(0.0)).alias(f"__f_{i}") for i, c in enumerate(features)]
    ready = stats.select("*", F.col(label).cast("double").alias("__y"), weight.alias("__w"), *named)
    score = stats if score is None else score
    pipe = Pipeline(
        stages=[
            VectorAssembler(inputCols=[f"__f_{i}" for i in range(len(features))], outputCol="__raw"),
            StandardScaler(inputCol="__raw", outputCol="__x", withMean=True, withStd=True),
            LogisticRegression(labelCol="__y", featuresCol="__x", weightCol="__w", maxIter=100, regParam=0.01, standardization=False),
        ]
    )
    out = pipe.fit(ready).transform(score.select("*", *named))
    return out.select(*score.columns, F.get(vector_to_array("probability"), F.lit(1)).alias("probability"))


def calibrate_by_group(
    stats: DataFrame, label: str, group: str, features: Sequence[str] = tuple(CALIBRATOR_FEATURES), penalties: Sequence[float] = (0.003, 0.03, 0.3)
) -> DataFrame:
    """``stats`` with ``probability`` from a model that saw no row of its group, and ``penalty``, the one chosen for all.

    Each group (a database) is one fold of a cross-validation; the penalty with the best mean ROC-AUC over the folds is
    kept, and each row is scored by the model its fold was held out from. Groups are few: their names reach the driver.
    """
    names = sorted(r[0] for r in stats.select(group).distinct().collect())
    if len(names) < 2:
        raise ValueError("a held-out group needs another group")
    fold = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(group)).cast("int") - 1
    named = [F.coalesce(number(c), F.lit(0.0)).alias(f"__f_{i}") for i, c in enumerate(features)]
    ready = stats.select("*", F.col(label).cast("double").alias("__y"), fold.alias("__fold"), *named).persist()
    # classes weigh the same among the rows fitted on, and only those; a stage of the pipeline sees no others
    share = "SELECT *, (SELECT avg(__y) FROM __THIS__) AS __share FROM __THIS__"
    balanced = SQLTransformer(statement=f"SELECT *, CASE WHEN __y = 1 THEN try_divide(0.5D, __share) ELSE try_divide(0.5D, 1 - __share) END AS __w FROM ({share})")
    model = LogisticRegression(labelCol="__y", featuresCol="__x", weightCol="__w", maxIter=100, standardization=False)
    pipe = Pipeline(stages=[
        balanced, VectorAssembler(inputCols=[f"__f_{i}" for i in range(len(features))], outputCol="__raw"),
        StandardScaler(inputCol="__raw", outputCol="__x", withMean=True, withStd=True), model,
    ])
    search = CrossValidator(
        estimator=pipe, estimatorParamMaps=ParamGridBuilder().addGrid(model.regParam, list(penalties)).build(),
        evaluator=BinaryClassificationEvaluator(labelCol="__y"), numFolds=len(names), foldCol="__fold", collectSubModels=True,
    )
    found = search.fit(ready)
    best = max(range(len(penalties)), key=lambda k: found.avgMetrics[k])
    ready.unpersist()
    out = [found.subModels[k][best].transform(ready.where(F.col("__fold") == k)) for k in range(len(names))]
    score = F.get(vector_to_array("probability"), F.lit(1)).alias("probability")
    return reduce(DataFrame.unionByName, [d.select(*stats.columns, score, F.lit(float(penalties[best])).alias("penalty")) for d in out])


def reliability(df: DataFrame, label: str, probability: str, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Per bin of equal width of the probability: rows, mean probability, share of true rows."""
    placed = df.withColumn("bin", F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("int"))
    return placed.groupBy(*by, "bin").agg(F.count("*").alias("n_rows"), F.avg(probability).alias("mean_probability"), F.avg(F.col(label).cast("double")).alias("share_true"))


def budget_curve(
    train: DataFrame, val: DataFrame, *, label: str, ranking: Sequence[str], budgets: Sequence[int], penalty: float = 1e-4
) -> DataFrame:
    """Metrics on ``val`` of logistic models of the first K features of a ranking, for every budget K.

    A feature is its value, gaps filled with the train median, and its missing indicator; both count as one. The matrix
    of all features is assembled and kept once, each budget slices its prefix, and one pass scores all of them.
    """
    budgets = sorted({k for k in budgets if 0 < k <= len(ranking)})
    flags = {f"{c}__is_missing": F.col(c).isNull().cast("double") for c in ranking}
    known = [d.where(F.col(label).isNotNull()).withColumns(flags) for d in (train, val)]
    filled = impute(known[0], known, list(ranking), [])
    columns = [x for c in ranking for x in (c, f"{c}__is_missing")]
    whole = VectorAssembler(inputCols=columns, outputCol="__all", handleInvalid="keep")
    a, b = (whole.transform(d.withColumn("__y", F.col(label).cast("double"))).select("__y", "__all") for d in filled)
    a = a.persist()
    scored = []
    for k in budgets:
        prefix = VectorSlicer(inputCol="__all", outputCol="__x", indices=list(range(2 * k)))
        model = LogisticRegression(labelCol="__y", featuresCol="__x", maxIter=200, tol=1e-9, regParam=penalty).fit(prefix.transform(a))
        p = F.get(vector_to_array("probability"), F.lit(1))
        scored.append(model.transform(prefix.transform(b)).select("__y", p.alias("__p"), F.lit(k).alias("budget")))
    a.unpersist()
    found = binary_metrics(reduce(DataFrame.unionByName, scored), "__y", "__p", ["budget"])
    return found.withColumn("n_columns", 2 * F.col("budget"))


def leakage_audit(
    train: DataFrame, val: DataFrame, *, label: str, row_key: Sequence[str], variants: Mapping[str, Sequence[str]], reference: str, replicates: int = 20, seed: int = 41
) -> DataFrame:
    """Per variant (a set of features) the metrics of its model on ``val`` and how far they stand above the reference's.

    variant, n_features, n_rows, roc_auc, average_precision, delta_roc_auc, delta_average_precision, low and high (the
    2.5 % and 97.5 % points of delta_roc_auc over bootstrap replicates of the validation rows). A variant that may see the
    future shows as an interval above 0. All variants score the same rows, a row has one Poisson weight a replicate for
    all of them, and replicates are sums over distinct scores beside the plain count.
    """
    if reference not in variants:
        raise ValueError(f"no variant {reference!r}")
    scored = [
        score_matrix(train, val, label=label, features=list(cols), row_key=row_key, task="logistic").select(F.lit(v).alias("variant"), *row_key, "y_true", "y_score")
        for v, cols in variants.items()
    ]
    rows = reduce(DataFrame.unionByName, scored).where(F.col("y_true").isNotNull())
    name = F.concat_ws("~", *[F.col(k).cast("string") for k in row_key], F.lit(str(seed)))
    weights = F.concat(F.array(F.lit(1)), poisson_weights(name, replicates))
    # a row's weights are drawn once for all variants, and a score has its replicates side by side while scores are ordered
    drawn = rows.groupBy(*row_key, "y_true").agg(F.collect_list(F.struct("variant", "y_score")).alias("__scores")).select(
        "y_true", "__scores", weights.alias("__w")
    ).select("y_true", "__w", F.explode("__scores").alias("s")).select(F.col("s.variant").alias("variant"), F.col("s.y_score").alias("__s"), "y_true", "__w")
    every = range(replicates + 1)
    sides = {"pos": F.col("y_true") == 1, "neg": ~F.coalesce(F.col("y_true") == 1, F.lit(False))}
    counts = drawn.groupBy("variant", "__s").agg(
        *[F.sum(F.when(here, F.get("__w", F.lit(b))).otherwise(0)).alias(f"{side}_{b}") for b in every for side, here in sides.items()]
    )
    running = [f"ge_{side}_{b}" for b in every for side in sides]
    ready = counts.select("*", (-F.col("__s")).alias("__o"), *[F.col(c.removeprefix("ge_")).alias(c) for c in running])
    above = prefix_scan(ready, ["variant"], "__o", adds=running, splits=BY_SIZE, marks_from=rows.select("variant", (-F.col("y_score")).alias("__o")))
    parts = ["pos", "neg", "ge_pos", "ge_neg"]
    above = above.select("variant", F.posexplode(F.array(*[F.struct(*[F.col(f"{c}_{b}").alias(c) for c in parts]) for b in every])).alias("replicate", "r"))
    above = above.select("variant", "replicate", "r.*").where(F.col("pos") + F.col("neg") > 0)
    ranks = ranking_aggregates(F.col("ge_pos"), F.col("ge_neg"))
    found = above.groupBy("variant", "replicate").agg(F.sum(F.col("pos") + F.col("neg")).alias("n_rows"), *[e.alias(k) for k, e in ranks.items()])
    base = found.where(F.col("variant") == reference).select("replicate", F.col("roc_auc").alias("base_auc"), F.col("average_precision").alias("base_ap"))
    deltas = found.join(base, "replicate").withColumns({"d_auc": F.col("roc_auc") - F.col("base_auc"), "d_ap": F.col("average_precision") - F.col("base_ap")})
    plain, drawn_only = F.col("replicate") == 0, F.col("replicate") > 0
    first = lambda c: F.max(F.when(plain, F.col(c)))
    edges = F.percentile(F.when(drawn_only, F.col("d_auc")), F.array(F.lit(0.025), F.lit(0.975)))
    sizes = F.create_map(*[x for v, cols in variants.items() for x in (F.lit(v), F.lit(len(cols)))])
    out = deltas.groupBy("variant").agg(
        first("n_rows").alias("n_rows"), first("roc_auc").alias("roc_auc"), first("average_precision").alias("average_precision"),
        first("d_auc").alias("delta_roc_auc"), first("d_ap").alias("delta_average_precision"), edges.alias("__edges"),
    )
    return out.select("variant", sizes[F.col("variant")].alias("n_features"), *out.columns[1:-1], F.col("__edges")[0].alias("low"), F.col("__edges")[1].alias("high"))


def calibration_heuristic(stats: DataFrame) -> DataFrame:
    """Fixed-weight score of the same statistics; a near-constant right side is penalised."""
    # fixed values: the weights
    c = lambda n, d=0.0: F.coalesce(F.col(n), F.lit(d))
    return stats.withColumn(
        "heuristic",
        1.5 * c("r_del") + c("r_ent") + 0.8 * c("lhs_support_repeated") + 0.5 * c("bootstrap_stability")
        + 0.3 * c("schema_flag") - 1.2 * c("lhs_uniqueness", 1.0) - F.when(c("rhs_entropy") < 0.05, 0.8).otherwise(0.0),
    )


def learn_program_ranker(known: DataFrame, candidates: DataFrame, features: Sequence[str], label: str, seed: int = 41) -> DataFrame:
    """Boosted trees on feature metadata; candidates come back with ``ranker_score``."""
    named = [F.coalesce(number(c), F.lit(0.0)).alias(f"__f_{i}") for i, c in enumerate(features)]
    pipe = Pipeline(
        stages=[
            VectorAssembler(inputCols=[f"__f_{i}" for i in range(len(features))], outputCol="__x"),
            GBTClassifier(labelCol="__y", featuresCol="__x", maxIter=10, maxDepth=3, seed=seed),
        ]
    )
    model = pipe.fit(known.select(F.col(label).cast("double").alias("__y"), *named))
    out = model.transform(candidates.select("*", *named))
    return out.select(*candidates.columns, F.get(vector_to_array("probability"), F.lit(1)).alias("ranker_score"))


OPPONENTS = 32  # candidates of the other label that a candidate is compared with


def ranking_pairs(candidates: DataFrame, *, group: str, item: str, label: str, features: Sequence[str], opponents: int = OPPONENTS) -> DataFrame:
    """(group, y, d_0, d_1, ..., weight): feature differences of candidates of one group with different labels.

    Each candidate meets up to ``opponents`` of the other label, so the pairs of a group grow with its candidates and not
    with their square; who meets whom is drawn by a hash of the name. y is 1 where the first of the two is a true one.
    All pairs of a group together weigh 1. A null label takes no part, and neither does a group with one label only.
    """
    numbered = candidates.where(F.col(label).isNotNull()).select(
        F.col(group).alias("g"), (F.col(label) == 1).alias("t"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"),
        (F.row_number().over(W.partitionBy(group, F.col(label) == 1).orderBy(F.md5(F.col(item).cast("string")), item)) - 1).alias("i"),
    )
    other = numbered.select("g", (~F.col("t")).alias("t"), F.col("x").alias("z"), F.col("i").alias("j"))
    sizes = other.groupBy("g", "t").agg(F.count("*").alias("m"))
    met = numbered.join(sizes, ["g", "t"]).select("*", F.explode(F.sequence(F.lit(0), F.least(F.lit(opponents), F.col("m")).cast("int") - 1)).alias("step"))
    met = met.withColumn("j", ((F.col("i") + F.col("step")) % F.col("m")).cast("int"))
    pairs = met.join(other, ["g", "t", "j"])
    per_group = pairs.groupBy("g").agg((1 / F.count("*")).alias("weight"))
    return pairs.join(per_group, "g").select(
        F.col("g").alias(group), F.col("t").cast("double").alias("y"), *[(F.col("x")[k] - F.col("z")[k]).alias(f"d_{k}") for k in range(len(features))], "weight"
    )


def rank_held_out(
    candidates: DataFrame, *, group: str, item: str, label: str, features: Sequence[str], opponents: int = OPPONENTS, penalty: float = 1e-3
) -> DataFrame:
    """``candidates`` with ``ranker_score`` and ``rank`` within their group, from a model that saw no row of the group.

    A group is a database with its task, a candidate one of its feature programs. The model is linear and learns from
    pairs: the logistic loss of the score difference between a true and another candidate of one group
    (``ranking_pairs``), without an intercept. Features are compared within a group, in standard deviations from its mean;
    a missing one counts as the mean. Ties go by name; rows without a group are left out. Groups are few, and their names
    reach the driver.
    """
    names = sorted(r[0] for r in candidates.select(group).dropna().distinct().collect())
    if len(names) < 2:
        raise ValueError("a held-out group needs another group")
    here = W.partitionBy(group)

    def scaled(c: str) -> Column:
        v = number(c)
        return F.coalesce(F.try_divide(v - F.avg(v).over(here), F.stddev_pop(v).over(here)), F.lit(0.0))

    z = [f"__z_{k}" for k in range(len(features))]
    rows = candidates.where(F.col(group).isNotNull()).withColumns({n: scaled(c) for n, c in zip(z, features, strict=True)})
    pairs = ranking_pairs(rows, group=group, item=item, label=label, features=z, opponents=opponents)
    vector = VectorAssembler(inputCols=[f"d_{k}" for k in range(len(features))], outputCol="x")
    ready = vector.transform(pairs).select(group, "y", "x", "weight").persist()
    score = F.lit(None).cast("double")
    for name in names:
        seen = ready.where(F.col(group) != name)
        if seen.isEmpty():
            raise ValueError(f"no group but {name!r} has candidates of both labels")
        model = LogisticRegression(labelCol="y", featuresCol="x", weightCol="weight", fitIntercept=False, standardization=False, regParam=penalty, maxIter=100)
        weights = model.fit(seen).coefficients.toArray().tolist()
        # rounded, so that the order in which tasks add up does not show
        dot = F.round(sum((F.col(n) * F.lit(w) for n, w in zip(z, weights, strict=True)), F.lit(0.0)), 10)
        score = F.when(F.col(group) == name, dot).otherwise(score)
    ready.unpersist()
    return ranked(rows.select(*candidates.columns, score.alias("ranker_score")), [F.desc("ranker_score"), F.col(item)], groups=[group])
