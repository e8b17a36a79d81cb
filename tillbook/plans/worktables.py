"""Intermediate results written once to the cluster's shared folder and read back.

A written table cuts lineage, outlives a lost executor and keeps parquet's column
pruning and filter pushdown. The folder is the one the cluster names in
``spark.checkpoint.dir``; a local session without that setting gets a scratch folder.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Ids in hexadecimal take half the bytes under zstd that they take under snappy.
CODEC = {"compression": "zstd"}


@functools.cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="tillbook-")


def work_folder(spark: SparkSession) -> str:
    """Folder for this application's work tables."""
    shared = spark.conf.get(SETTING, None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {SETTING} to a folder that every executor can reach")
        shared = _local_scratch()
    return f"{shared.rstrip('/')}/tillbook/{spark.sparkContext.applicationId}"


#: Folders of the contexts that are open, the innermost last.
_SCOPES: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    folder = _SCOPES[-1] if _SCOPES else work_folder(spark)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once and return a scan of what was written."""
    path = new_path(df.sparkSession, label)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.options(**CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def work_tables(spark: SparkSession) -> Iterator[None]:
    """Work tables written inside are removed at the end; write results before that."""
    folder = f"{work_folder(spark)}/scope-{uuid.uuid4().hex}"
    _SCOPES.append(folder)
    try:
        yield
    finally:
        _SCOPES.remove(folder)
        _remove(spark, folder)


def drop_work_tables(spark: SparkSession) -> None:
    """Remove all work tables of this application."""
    _remove(spark, work_folder(spark))


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
