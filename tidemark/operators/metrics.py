"""Prediction metrics as aggregates over a predictions table, exact and grouped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import all_numbers, canonical_class
from tidemark.operators.scan import BY_SIZE, exact_medians, prefix_scan

EPS = 1e-15


def score_counts(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score: all that ranking metrics need, combined map-side."""
    rows = df.where(F.col(y).isNotNull() & F.col(score).isNotNull())
    return rows.groupBy(*by, F.col(score).cast("double").alias("__s")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg")
    )


def ranking_aggregates(ge_pos: Column, ge_neg: Column) -> dict[str, Column]:
    """ROC-AUC (ties averaged) and average precision (ties grouped) from counts at or above a score."""
    pos, neg = F.col("pos"), F.col("neg")
    p, n = F.sum(pos).cast("double"), F.sum(neg).cast("double")
    auc = (p * n - F.sum(pos.cast("double") * ge_neg) + F.sum(pos.cast("double") * neg) / 2) / (p * n)
    ap = F.sum(pos * (ge_pos / (ge_pos + ge_neg))) / p
    return {"roc_auc": F.when((p > 0) & (n > 0), auc), "average_precision": F.when(p > 0, ap)}


def with_counts_above(counts: DataFrame, by: Sequence[str], splits: int = BY_SIZE, raw: DataFrame | None = None) -> DataFrame:
    """Add counts at or above each score; the score order is cut into slices, so groups may be huge.

    ``raw`` holds the scores ``__s`` before counting and is only used to place the slice boundaries.
    """
    ready = counts.select("*", (-F.col("__s")).alias("__o"), F.col("pos").alias("ge_pos"), F.col("neg").alias("ge_neg"))
    marks = raw.select(*by, (-F.col("__s")).alias("__o")) if raw is not None else None
    return prefix_scan(ready, list(by), "__o", adds=["ge_pos", "ge_neg"], splits=splits, marks_from=marks).drop("__o")


def binary_metrics(
    df: DataFrame, y: str, score: str, by: Sequence[str] = (), *, threshold: float = 0.5, eps: float = EPS, splits: int = BY_SIZE
) -> DataFrame:
    """Rows, accuracy, ROC-AUC, average precision and clipped log-loss per group, in one pass over scores."""
    raw = df.where(F.col(score).isNotNull()).select(*by, F.col(score).cast("double").alias("__s"))
    above = with_counts_above(score_counts(df, y, score, by), by, splits, raw)
    p = F.least(F.greatest(F.col("__s"), F.lit(eps)), F.lit(1 - eps))
    pos, neg = F.col("pos"), F.col("neg")
    n = F.sum(pos + neg)
    right = F.sum(F.when(F.col("__s") >= threshold, pos).otherwise(neg))
    loss = -F.sum(pos * F.ln(p) + neg * F.ln(1 - p))
    ranks = ranking_aggregates(F.col("ge_pos"), F.col("ge_neg"))
    return above.groupBy(*by).agg(
        n.alias("n_rows"), (right / n).alias("accuracy"), *[e.alias(k) for k, e in ranks.items()], (loss / n).alias("log_loss")
    )


def multiclass_metrics(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and micro/macro/weighted F1 from confusion counts; zero where a class has no hit."""
    numeric = all_numbers((df, y), (df, pred))
    cells = (
        df.select(*by, canonical_class(y, numeric).alias("t"), canonical_class(pred, numeric).alias("p"))
        .dropna(subset=["t", "p"])
        .groupBy(*by, "t", "p")
        .agg(F.count("*").alias("n"))
    )
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    sides = F.explode(
        F.array(
            F.struct(F.col("t").alias("c"), F.col("n").alias("true"), F.lit(0).cast("bigint").alias("said"), hit.alias("hit")),
            F.struct(F.col("p").alias("c"), F.lit(0).cast("bigint").alias("true"), F.col("n").alias("said"), F.lit(0).cast("bigint").alias("hit")),
        )
    )
    per_class = cells.select(*by, sides.alias("s")).groupBy(*by, "s.c").agg(
        F.sum("s.true").alias("true"), F.sum("s.said").alias("said"), F.sum("s.hit").alias("hit")
    )
    f1 = F.when(F.col("hit") > 0, 2.0 * F.col("hit") / (F.col("true") + F.col("said"))).otherwise(0.0)
    total = F.sum("true")
    return per_class.groupBy(*by).agg(
        total.alias("n_rows"), (F.sum("hit") / total).alias("accuracy"), (F.sum("hit") / total).alias("f1_micro"),
        F.avg(f1).alias("f1_macro"), (F.sum(f1 * F.col("true")) / total).alias("f1_weighted"),
    )


def probability_metrics(df: DataFrame, true_index: str, probabilities: str, by: Sequence[str] = (), eps: float = EPS) -> DataFrame:
    """Multiclass log-loss and mean reciprocal rank from a class-probability array and the true position."""
    p = F.get(probabilities, F.col(true_index).cast("int"))
    rank = 1 + F.size(F.filter(probabilities, lambda q: q > F.col("__p")))
    return (
        df.withColumn("__p", p)
        .where(F.col("__p").isNotNull())
        .groupBy(*by)
        .agg(
            F.count("*").alias("n_rows"), F.avg(-F.ln(F.greatest(F.col("__p"), F.lit(eps)))).alias("log_loss"),
            F.avg(1.0 / rank).alias("mrr"),
        )
    )


def regression_metrics(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE and R2; R2 is NULL for a constant truth."""
    rows = df.where(F.col(y).isNotNull() & F.col(pred).isNotNull())
    e = F.col(y).cast("double") - F.col(pred).cast("double")
    spread = F.var_pop(F.col(y).cast("double"))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.when(spread > 0, 1 - F.avg(e * e) / spread).alias("r2"),
    )


def log_regression_metrics(df: DataFrame, y: str, pred: str, by: Sequence[str] = (), splits: int = BY_SIZE) -> DataFrame:
    """The same on log(1 + x) after clipping at 0, with the exact median absolute error on the plain scale."""
    clipped = df.where(F.col(y).isNotNull() & F.col(pred).isNotNull()).select(
        *by,
        F.greatest(F.col(y).cast("double"), F.lit(0.0)).alias("__y"),
        F.greatest(F.col(pred).cast("double"), F.lit(0.0)).alias("__p"),
    )
    logs = clipped.select(*by, F.log1p("__y").alias("y"), F.log1p("__p").alias("p"))
    base = regression_metrics(logs, "y", "p", by).select(
        *by, F.col("rmse").alias("log_rmse"), F.col("mae").alias("log_mae"), F.col("r2").alias("log_r2")
    )
    gaps = clipped.select(*by, F.abs(F.col("__y") - F.col("__p")).alias("gap"))
    med = exact_medians(gaps, ["gap"], by, splits=splits).select(*by, F.col("median").alias("median_abs_error"))
    if by:
        return base.join(med, list(by))
    return base.withColumn("median_abs_error", med.scalar())


def constant_baselines(train: DataFrame, val: DataFrame, *, binary: str, numeric: str, eps: float = EPS) -> DataFrame:
    """One row: train prevalence and its log-loss on ``val``; train median and its MAE/RMSE on ``val``."""
    p = F.least(F.greatest(F.col("prevalence"), F.lit(eps)), F.lit(1 - eps))
    rate = train.agg(F.avg(F.col(binary).cast("double"))).scalar()
    middle = exact_medians(train.select(numeric), [numeric]).select("median").scalar()
    rows = val.select(binary, numeric).withColumn("prevalence", rate).withColumn("train_median", middle)
    e = F.col(numeric) - F.col("train_median")
    return rows.agg(
        F.max("prevalence").alias("prevalence"),
        F.avg(-(F.col(binary) * F.ln(p) + (1 - F.col(binary)) * F.ln(1 - p))).alias("log_loss"),
        F.max("train_median").alias("train_median"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
    )


def subgroup_gains(df: DataFrame, y: str, base_pred: str, new_pred: str, group: Column) -> DataFrame:
    """Accuracy of two predictions and the gain, per subgroup (for example cold against warm rows)."""
    ok_a = (F.col(y) == F.col(base_pred)).cast("int")
    ok_b = (F.col(y) == F.col(new_pred)).cast("int")
    return df.groupBy(group.alias("subgroup")).agg(
        F.count("*").alias("n_rows"), F.avg(ok_a).alias("base_accuracy"), F.avg(ok_b).alias("new_accuracy"),
        (F.avg(ok_b) - F.avg(ok_a)).alias("gain"),
    )


def prediction_rows(matrix: DataFrame, predictions: DataFrame, row_key: Sequence[str], metadata: Sequence[str]) -> DataFrame:
    """Predictions beside row metadata, aligned by row key."""
    return matrix.select(*row_key, *metadata).join(predictions, list(row_key))
