"""Folders and files that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from tidemark.session import ensure_checkpoint_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder of the session."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it; works on driver and executors alike."""
    return fs.FileSystem.from_uri(uri)


def kept(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """The frame written to the shared folder and read back: lineage is cut and losing an executor costs nothing."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
