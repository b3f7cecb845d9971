"""Publishing a table: written aside, checked by reading it back, listed in a manifest, and moved into place at once."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DATA, MANIFEST = "data", "manifest"


def _row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)], *[F.col(f"`{c}`").isNull() for c in sorted(df.columns)])


def _listed(table: DataFrame) -> DataFrame:
    """(file, n_rows, hash_xor, hash_sum) of the files a table is read from. Their order and the rows' order within don't matter."""
    h = _row_hash(table)
    return table.select(F.regexp_extract("_metadata.file_path", f"/{DATA}/(.*)$", 1).alias("file"), h.alias("h")).groupBy("file").agg(
        F.count("*").alias("n_rows"), F.bit_xor("h").alias("hash_xor"), F.sum(F.pmod("h", F.lit(1_000_003))).alias("hash_sum")
    )


def publish(df: DataFrame, folder: str, *, partition_by: Sequence[str] = (), check_source: bool = False) -> DataFrame:
    """Writes ``df`` as ``folder``/data with ``folder``/manifest, and returns the manifest.

    Files are written aside, read back and listed with rows and hashes; ``check_source`` computes ``df`` once more and holds
    its rows against theirs. A reader sees all of the folder or none: both parts are moved in by one rename, and a job that
    fails leaves nothing under ``folder``. A folder that exists is an error, and so is a column of type map, which has no
    hash. Partition columns hold no nulls and keep their type.
    """
    spark = df.sparkSession
    where, path = fs.FileSystem.from_uri(folder)
    if where.get_file_info(path).type != fs.FileType.NotFound:
        raise ValueError(f"{folder} exists")
    aside = f"{folder.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.parquet(f"{aside}/{DATA}", partitionBy=list(partition_by) or None)
    _listed(_data(spark, aside, df)).write.parquet(f"{aside}/{MANIFEST}")
    if check_source:
        h = _row_hash(df)
        source = df.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1_000_003)))).first()
        if tuple(source) != tuple(spark.read.parquet(f"{aside}/{MANIFEST}").agg(F.coalesce(F.sum("n_rows"), F.lit(0)), F.bit_xor("hash_xor"), F.sum("hash_sum")).first()):
            raise ValueError(f"rows in {aside} differ from the table they come from")
    where.move(fs.FileSystem.from_uri(aside)[1], path)
    return spark.read.parquet(f"{folder}/{MANIFEST}")


def _data(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(f"{folder}/{DATA}")


def read_published(spark: SparkSession, folder: str, like: DataFrame | None = None) -> DataFrame:
    """The published table; with ``like``, of its schema."""
    return spark.read.parquet(f"{folder}/{DATA}") if like is None else _data(spark, folder, like)


def verify(spark: SparkSession, folder: str, like: DataFrame | None = None) -> DataFrame:
    """Per file of manifest or folder: (file, state), one of same, changed, missing, unlisted."""
    old = spark.read.parquet(f"{folder}/{MANIFEST}")
    new = _listed(read_published(spark, folder, like))
    both = old.select("file", F.struct("n_rows", "hash_xor", "hash_sum").alias("o")).join(new.select("file", F.struct("n_rows", "hash_xor", "hash_sum").alias("w")), "file", "full_outer")
    state = F.when(F.col("w").isNull(), "missing").when(F.col("o").isNull(), "unlisted").when(F.col("o") == F.col("w"), "same").otherwise("changed")
    return both.select("file", state.alias("state"))
