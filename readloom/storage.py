"""Tables in the folder that the driver and all executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir. Only a run on one machine may leave that unset: it gets a local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir is unset: on {master} it must name a folder that all executors and the driver share")
        base = tempfile.mkdtemp(prefix="readloom-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a statement run in here go when it ends; its result must be a written table."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def deleted(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _written(df: DataFrame, path: str, compression: str | None = None) -> DataFrame:
    with freed_shuffles(df.sparkSession):
        (df.write.option("compression", compression) if compression else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """df written and read again: a cut of the lineage that outlives lost executors. compression: a codec of Parquet, by default the session's."""
    return _written(df, shared_path(df.sparkSession, name), compression)


class Steps:
    """The written tables of one computation. Those not dropped before go when the block ends, also by an error."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Steps:
        return self

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_path(self.spark, name)
        self.paths.append((df, path))  # also a table whose writing fails goes
        out = _written(df, path)
        self.paths[-1] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df, path in [(d, p) for d, p in self.paths if any(d is t for t in tables)]:
            self.paths = [x for x in self.paths if x[1] != path]
            deleted(self.spark, path)

    def __exit__(self, *_: object) -> None:
        for _df, path in self.paths:
            deleted(self.spark, path)
        self.paths = []
