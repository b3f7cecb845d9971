"""Access to the driver tables and small shaping helpers shared by the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Averages of two-decimal values often fall exactly on a rounding tie, where the order of summation
# would decide the last digit. Both sides add this share of the last digit before rounding.
NUDGE = 0.0213


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, so that summation order does not show."""
    return df.select(*[round_to(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def round_to(column: str, digits: int):
    return F.round(F.col(column) + F.lit(NUDGE * 10**-digits), digits)


def nudged(sql: str) -> str:
    """The same nudge inside every ``round(x, d)`` of an oracle query."""
    out, i = [], 0
    while (j := sql.find("round(", i)) >= 0:
        depth, k, comma = 1, j + 6, -1
        while depth:
            ch = sql[k]
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 1:
                comma = k
            k += 1
        digits = int(sql[comma + 1 : k - 1])
        out.append(f"{sql[i:j]}round(({nudged(sql[j + 6 : comma])}) + {NUDGE * 10**-digits!r}, {digits})")
        i = k
    return "".join(out) + sql[i:]


def orders_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their customer and order time."""
    lines = load(spark, sf_dir, "lineitem")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey)


def customer_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with nation and region names; one customer in ten has region MIXED."""
    c = load(spark, sf_dir, "customer")
    n = load(spark, sf_dir, "nation")
    r = load(spark, sf_dir, "region")
    return (
        c.join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            "c_custkey", "c_mktsegment", "n_name",
            F.when(F.col("c_custkey") % 10 == 3, F.lit("MIXED")).otherwise(F.col("r_name")).alias("r_name"),
            "n_regionkey",
        )
    )


CUSTOMER_GEO_SQL = """customer_geo AS (
  SELECT c_custkey, c_mktsegment, n_name,
         CASE WHEN c_custkey % 10 = 3 THEN 'MIXED' ELSE r_name END AS r_name, n_regionkey
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
