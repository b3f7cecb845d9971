"""Column expressions: casts, indicators, labels, hashing."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "input") -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {missing}")


def as_time(df: DataFrame, column: str) -> Column:
    """Time column of ``df``; dates become zone-free timestamps so that intervals stay zone-free."""
    if isinstance(df.schema[column].dataType, T.DateType):
        return F.col(column).cast("timestamp_ntz")
    return F.col(column)


def seconds_between(start: Column, end: Column) -> Column:
    """Exact elapsed seconds as a double, without passing through the session time zone."""
    span = (end - start).cast(T.DayTimeIntervalType(3, 3))
    return span.cast("decimal(18,6)").cast("double")


def days_between(start: Column, end: Column) -> Column:
    """Fractional days."""
    return seconds_between(start, end) / F.lit(86400.0)


def days_interval(days: int) -> Column:
    return F.make_dt_interval(days=F.lit(days))


ONE_MICRO = "INTERVAL '0.000001' SECOND"


def tick() -> Column:
    """The smallest step of a Spark timestamp."""
    return F.expr(ONE_MICRO)


def number(column: Column | str) -> Column:
    """Double or NULL, never an error; NaN and infinities count as missing."""
    x = (F.col(column) if isinstance(column, str) else column).try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x)


def is_missing(column: str) -> Column:
    return F.col(column).isNull().cast("int").alias(f"{column}__is_missing")


def with_indicators(df: DataFrame, columns: Sequence[str], fill: float | None = None) -> DataFrame:
    """Add ``c__is_missing`` per column, and fill the column itself when ``fill`` is given."""
    require_columns(df, columns)
    flags = [is_missing(c) for c in columns]
    if fill is None:
        return df.select("*", *flags)
    wanted = set(columns)
    values = [F.coalesce(F.col(c), F.lit(fill)).alias(c) if c in wanted else F.col(c) for c in df.columns]
    return df.select(*values, *flags)


def fill_numbers(df: DataFrame, columns: Sequence[str], value: float = 0.0) -> DataFrame:
    """Infinities and NaN to NULL, then NULL to ``value``."""
    wanted = set(columns)
    return df.select(*[F.coalesce(number(c), F.lit(value)).alias(c) if c in wanted else F.col(c) for c in df.columns])


def null_key_to(column: str, sentinel: int = -1) -> Column:
    return F.coalesce(F.col(column).cast("bigint"), F.lit(sentinel)).alias(column)


def calendar_parts(df: DataFrame, time_col: str) -> DataFrame:
    """Year, month, day and weekday (Monday = 0) in place of the timestamp."""
    t = F.col(time_col)
    return df.select(
        *[c for c in df.columns if c != time_col],
        F.year(t).alias(f"{time_col}__year"),
        F.month(t).alias(f"{time_col}__month"),
        F.dayofmonth(t).alias(f"{time_col}__day"),
        F.weekday(t).alias(f"{time_col}__dow"),
    )


def epoch_seconds(time: Column) -> Column:
    return seconds_between(F.lit("1970-01-01").cast("timestamp_ntz"), time.cast("timestamp_ntz"))


def text_flags(column: str) -> list[Column]:
    """Character length (NULL for NULL text) and presence."""
    c = F.col(column)
    return [
        F.length(c).cast("bigint").alias(f"{column}__len"),
        c.isNotNull().cast("int").alias(f"{column}__present"),
    ]


def at_least(column: str, threshold: float, strict: bool = False) -> Column:
    """0/1 label from a threshold; NULL counts as 0."""
    y = F.coalesce(F.col(column).try_cast("double"), F.lit(0.0))
    return ((y > threshold) if strict else (y >= threshold)).cast("int")


def log1p_label(column: str) -> Column:
    """log(1 + y); negative or missing labels are an error."""
    y = F.col(column).cast("double")
    return F.when(y >= 0, F.log1p(y)).otherwise(
        F.raise_error(F.lit(f"{column}: label must be present and not negative")).cast("double")
    )


# Spellings of binary labels.
TRUE_WORDS = ["t", "true", "1", "1.0", "yes", "y"]
FALSE_WORDS = ["f", "false", "0", "0.0", "no", "n"]


def binary_label(column: Column | str) -> Column:
    """0/1 from text, boolean or number; anything else is an error."""
    c = F.col(column) if isinstance(column, str) else column
    word = F.lower(F.trim(c.cast("string")))
    return (
        F.when(word.isin(TRUE_WORDS), F.lit(1))
        .when(word.isin(FALSE_WORDS), F.lit(0))
        .otherwise(F.raise_error(F.concat(F.lit("not a binary label: "), F.coalesce(word, F.lit("NULL")))).cast("int"))
    )


def all_numbers(*tables: tuple[DataFrame, str]) -> Column:
    """Whether all values of the (table, column) pairs read as numbers, as a scalar subquery."""
    one = [df.agg(F.coalesce(F.bool_and(F.col(c).isNull() | F.trim(F.col(c).cast("string")).try_cast("double").isNotNull()), F.lit(True))).scalar() for df, c in tables]
    out = one[0]
    for o in one[1:]:
        out = out & o
    return out


def canonical_class(column: Column | str, numeric: Column | None = None) -> Column:
    """Class name under which ``6``, ``6.0`` and ``'6'`` agree.

    ``numeric`` says whether the whole column is numbers (see ``all_numbers``): if not, every value stays the
    text it is; without it, each value is judged by itself.
    """
    c = F.col(column) if isinstance(column, str) else column
    text = F.trim(c.cast("string"))
    x = text.try_cast("double")
    whole = (x == F.floor(x)) & (F.abs(x) < F.lit(1e15))
    if numeric is not None:
        whole, x = whole & numeric, F.when(numeric, x)
    return F.when(whole, x.cast("bigint").cast("string")).when(x.isNotNull(), x.cast("string")).otherwise(text)


def symbol(df: DataFrame, column: str) -> Column:
    """Grouping symbol: arrays join with ``|``, everything else becomes text, NULL stays NULL."""
    if isinstance(df.schema[column].dataType, T.ArrayType):
        return F.when(
            F.col(column).isNotNull(),
            F.array_join(F.transform(F.col(column), lambda v: v.cast("string")), "|"),
        )
    return F.col(column).cast("string")


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def xlogx(n: Column) -> Column:
    return F.when(n > 0, n * F.ln(n.cast("double"))).otherwise(F.lit(0.0))


def key_text(keys: Sequence[str], *salt: object) -> Column:
    """Text of the key columns and a salt, the input of every deterministic draw."""
    parts = [F.col(k).cast("string") for k in keys] + [F.lit(str(s)) for s in salt]
    return F.concat_ws("~", *parts)


def hash_hex(keys: Sequence[str], *salt: object) -> Column:
    return F.md5(key_text(keys, *salt))


def hash_int(text: Column) -> Column:
    """32 uniform bits of the MD5 of ``text`` as a bigint; every engine agrees on it."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


# Cumulative Poisson(1) probabilities of 0..8.
POISSON_STEPS = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563,
                 0.9994058151824183, 0.999916758850712, 0.9999897508033253, 0.9999988747974021]


def poisson_weight(text: Column) -> Column:
    """A Poisson(1) count of 0 to 9 drawn from ``text``: how often a bootstrap replicate holds a row."""
    h = hash_int(text)  # 2**32 uniform levels: the hash itself is compared with scaled thresholds
    return sum((F.when(h >= int(s * 4294967296), 1).otherwise(0) for s in POISSON_STEPS), F.lit(0))


def poisson_weights(text: Column, replicates: int) -> Column:
    """``poisson_weight`` of ``text`` and each replicate's number, as an array; its code doesn't grow with the replicates."""
    steps = F.array(*[F.lit(int(s * 4294967296)) for s in POISSON_STEPS])
    drawn = F.transform(F.array(*[F.lit(str(b)) for b in range(replicates)]), lambda b: hash_int(F.concat_ws("~", text, b)))
    return F.transform(drawn, lambda h: F.size(F.filter(steps, lambda s: s <= h)))


def uniform(text: Column) -> Column:
    """Uniform in (0, 1)."""
    return (hash_int(text) + F.lit(0.5)) / F.lit(4294967296.0)


def gaussian(keys: Sequence[str], *salt: object) -> Column:
    """Standard normal draw tied to the row key, so it survives repartitioning and retries."""
    u1 = uniform(key_text(keys, *salt, "u"))
    u2 = uniform(key_text(keys, *salt, "v"))
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(6.283185307179586) * u2)
