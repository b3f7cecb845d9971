"""Reading and writing relational bundles: one Parquet folder per table."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ensure_checkpoint_dir


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns is not None else df


def read_bundle(spark: SparkSession, folder: str, tables: Sequence[str], splits: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Tables ``table_<name>.parquet`` and targets ``target_<split>.parquet`` of an exported bundle."""
    out = {t: spark.read.parquet(f"{folder}/table_{t}.parquet") for t in tables}
    out.update({f"target_{s}": spark.read.parquet(f"{folder}/target_{s}.parquet") for s in splits})
    return out


def register_views(tables: Mapping[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet through the commit protocol: readers see all files and ``_SUCCESS``, or nothing new."""
    df.write.mode("overwrite").parquet(path, partitionBy=list(partition_by) or None)


def written_once(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared checkpoint folder and read back: what is read several times is computed once."""
    folder = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def bundle_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per table: rows, columns, column names."""
    rows = [
        df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"),
            F.lit(",".join(df.columns)).alias("column_names"),
        )
        for name, df in tables.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), rows)
