"""The folder that driver and executors share, and tables that cut lineage."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder, and that only if driver and executors are one process, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tributary-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a path, in whatever store it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class scratch:
    """Tables written inside, but for those with keep=True, are deleted at the end: a result must be written, too, before."""

    _mine = threading.local()  # a thread's tables are its own: runs and micro-batches may go on at once

    def __init__(self, spark: SparkSession):
        self.spark = spark

    @classmethod
    def open_tables(cls) -> list[list[str]]:
        if not hasattr(cls._mine, "tables"):
            cls._mine.tables = []
        return cls._mine.tables

    def __enter__(self) -> None:
        self.open_tables().append([])

    def __exit__(self, *_) -> None:
        for path in self.open_tables().pop():
            delete(self.spark, path)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: later jobs neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tributary/{name}-{uuid.uuid4().hex}"
    tables = scratch.open_tables()
    if tables[keep:]:
        tables[-1 - keep].append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` gave and that nothing will read again."""
    for t in tables:
        if path := getattr(t, "_written_to", None):
            delete(t.sparkSession, path)
