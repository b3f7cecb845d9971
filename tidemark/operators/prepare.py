"""Row and column preparation fitted on one split and applied to others."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import all_numbers, canonical_class, number, require_columns
from tidemark.operators.scan import BY_SIZE, bounded, exact_medians, numbered


def expand_array(df: DataFrame, column: str, size: int | None = None) -> DataFrame:
    """Array column to ``column__0 .. column__n-1``; short arrays give NULL, the source is dropped."""
    require_columns(df, [column])
    if size is None:
        size = df.agg(F.max(F.size(column))).first()[0] or 0
    return df.select(
        *[c for c in df.columns if c != column], *[F.get(column, F.lit(i)).alias(f"{column}__{i}") for i in range(size)]
    )


def keep_seen_classes(train: DataFrame, val: DataFrame, label: str) -> DataFrame:
    """Validation rows whose class occurs in training; the class list combines map-side."""
    numeric = all_numbers((train, label), (val, label))
    seen = train.select(canonical_class(label, numeric).alias("__cls")).where(F.col("__cls").isNotNull()).distinct()
    return val.withColumn("__cls", canonical_class(label, numeric)).join(seen, "__cls", "left_semi").drop("__cls")


def unseen_class_report(train: DataFrame, val: DataFrame, label: str) -> DataFrame:
    """One row: validation rows, rows kept, rows dropped for an unseen class."""
    numeric = all_numbers((train, label), (val, label))
    seen = train.select(canonical_class(label, numeric).alias("__cls")).distinct().withColumn("__seen", F.lit(1))
    per_class = val.select(canonical_class(label, numeric).alias("__cls")).groupBy("__cls").agg(F.count("*").alias("n"))
    return per_class.join(seen, "__cls", "left").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("__seen").isNotNull(), F.col("n"))), F.lit(0)).alias("kept"),
        F.coalesce(F.sum(F.when(F.col("__seen").isNull(), F.col("n"))), F.lit(0)).alias("dropped"),
    )


def require_seen_classes(train: DataFrame, val: DataFrame, label: str) -> DataFrame:
    """``keep_seen_classes``, but an error where no validation row has a class of the training rows."""
    kept = keep_seen_classes(train, val, label)
    if kept.isEmpty():
        raise ValueError("no validation row has a class that occurs in training")
    return kept


def _per_column(df: DataFrame, columns: Sequence[str], parts: Mapping[str, object]) -> DataFrame:
    """(column, part, ...) from one wide aggregate: a single pass, no row expansion."""
    wide = df.agg(*[fn(c).alias(f"{p}_{i}") for i, c in enumerate(columns) for p, fn in parts.items()])
    rows = F.array(
        *[F.struct(F.lit(c).alias("column"), *[F.col(f"{p}_{i}").alias(p) for p in parts]) for i, c in enumerate(columns)]
    )
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def column_variation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: rows, non-null rows, and whether it takes more than one value (NULL counts as one)."""
    out = _per_column(
        df, columns,
        {
            "n_rows": lambda c: F.count(F.lit(1)),
            "n_present": lambda c: F.count(c),
            "moves": lambda c: F.coalesce(F.min(c) < F.max(c), F.lit(False)),
        },
    )
    mixed = (F.col("n_present") > 0) & (F.col("n_present") < F.col("n_rows"))
    return out.select("column", "n_rows", "n_present", (F.col("moves") | mixed).alias("varies"))


def varying_columns(train: DataFrame, columns: Sequence[str]) -> list[str]:
    """Names of columns not constant in training, in the given order (one small row to the driver)."""
    keep = {r["column"] for r in column_variation(train, columns).where("varies").collect()}
    return [c for c in columns if c in keep]


def present_columns(train: DataFrame, columns: Sequence[str]) -> list[str]:
    """Names of columns with at least one value in training."""
    keep = {r["column"] for r in column_variation(train, columns).where("n_present > 0").collect()}
    return [c for c in columns if c in keep]


def stable_features(splits: Mapping[str, DataFrame], columns: Sequence[str], max_null_rate: float) -> DataFrame:
    """Null rate per split and column, and whether the column stays under the limit on every split."""
    rates = []
    for name, df in splits.items():
        one = _per_column(df, columns, {"rate": lambda c: F.avg(F.col(c).isNull().cast("int"))})
        rates.append(one.withColumnRenamed("rate", f"null_rate_{name}"))
    joined = reduce(lambda a, b: a.join(bounded(b, len(columns)), "column"), rates)
    worst = [F.col(f"null_rate_{n}") for n in splits]
    return joined.withColumn("kept", (F.greatest(*worst) if len(worst) > 1 else worst[0]) <= max_null_rate)


def fit_fill_values(train: DataFrame, numeric: Sequence[str], text: Sequence[str]) -> DataFrame:
    """(column, number, word): exact train median of numbers, train mode of texts (smallest on ties)."""
    parts = []
    if numeric:
        clean = train.select(*[number(c).alias(c) for c in numeric])
        parts.append(
            exact_medians(clean, numeric).select(
                F.col("feature").alias("column"), F.col("median").alias("number"), F.lit(None).cast("string").alias("word")
            )
        )
    if text:
        long = train.select(*[F.col(c).cast("string").alias(c) for c in text]).unpivot([], list(text), "column", "word")
        counts = long.where(F.col("word").isNotNull()).groupBy("column", "word").agg(F.count("*").alias("n"))
        top = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("n"), "word"))["word"].alias("word"))
        parts.append(top.select("column", F.lit(None).cast("double").alias("number"), "word"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def impute(train: DataFrame, frames: Sequence[DataFrame], numeric: Sequence[str], text: Sequence[str]) -> list[DataFrame]:
    """Fill every frame with values fitted on ``train``; the fill values (one per column) become literals."""
    fills = {r["column"]: r for r in fit_fill_values(train, numeric, text).collect()}

    def one(df: DataFrame, c: str) -> Column:
        if c in numeric:
            value = fills[c]["number"] if c in fills else None
            return F.coalesce(number(c), F.lit(value).cast("double")).alias(c)
        if c in text:
            value = fills[c]["word"] if c in fills else None
            return F.coalesce(F.col(c).cast("string"), F.lit(value).cast("string")).alias(c)
        return F.col(c)

    return [df.select(*[one(df, c) for c in df.columns]) for df in frames]


def ordinal_codes(frames: Sequence[DataFrame], column: str) -> DataFrame:
    """(column, code): sorted distinct values of all frames numbered from 0, in slices of the value order."""
    values = reduce(lambda a, b: a.unionAll(b), [f.select(F.col(column).cast("string").alias(column)) for f in frames])
    distinct = values.where(F.col(column).isNotNull()).distinct()
    coded = numbered(distinct, [], [F.col(column)], "code", splits=BY_SIZE)
    return coded.withColumn("code", (F.col("code") - 1).cast("bigint"))


def encode_jointly(frames: Sequence[DataFrame], columns: Sequence[str]) -> list[DataFrame]:
    """Replace text columns by codes shared by all frames; NULL becomes -1."""
    out = list(frames)
    for c in columns:
        codes = ordinal_codes(frames, c).withColumnRenamed(c, "__v").withColumnRenamed("code", "__code")
        out = [
            df.join(codes, df[c].cast("string") == F.col("__v"), "left")
            .withColumn(c, F.coalesce("__code", F.lit(-1).cast("bigint")))
            .drop("__v", "__code")
            for df in out
        ]
    return out


def align_columns(df: DataFrame, like: DataFrame, fill: float | None = None) -> DataFrame:
    """Columns of ``like`` in its order: extra ones go, absent ones become NULL or ``fill``."""
    have = set(df.columns)
    return df.select(
        *[F.col(c) if c in have else F.lit(fill).cast(kind).alias(c) for c, kind in like.dtypes]
    )
