"""Bin counts of reads that keep arriving, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cores import candidates


def arriving(spark: SparkSession, folder: str, files_a_batch: int = 16) -> DataFrame:
    """Parquet files of (read_id, seq) as they appear in a folder."""
    return spark.readStream.schema("read_id long, seq string").option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def running_counts(stream: DataFrame, cores: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends each micro-batch's counts (batch_id, core_id, n_reads) to the table at path; a batch
    that is run again after a failure replaces its own rows only."""

    def put(batch: DataFrame, batch_id: int) -> None:
        found = candidates(batch, cores).groupBy("read_id").agg(F.min(F.struct(-F.length("core"), "pos", "core_id")).alias("b"))
        counts = found.groupBy(F.col("b.core_id").alias("core_id")).agg(F.count("*").alias("n_reads"))
        counts.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("core_id").agg(F.sum("n_reads").alias("n_reads"))
