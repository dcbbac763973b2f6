"""Mates: joined by their place in two files, or taken apart from one interleaved file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def zipped(first: DataFrame, second: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Reads of both files at the same place; the second's name is not kept. A place only one file has is left out."""
    mates = second.select(ordinal, F.col("seq").alias("seq2"), F.col("qual").alias("qual2"))
    return first.join(mates, ordinal)


def deinterleaved(reads: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Records 2k and 2k+1 as the mates of pair k."""
    pair = reads.withColumn("pair", F.expr(f"{ordinal} div 2")).withColumn("mate", F.expr(f"{ordinal} % 2") + 1)
    return pair.groupBy("pair").agg(
        *[F.max(F.when(F.col("mate") == m, F.col(c))).alias(f"{c}{m if m > 1 else ''}") for m in (1, 2) for c in ("seq", "qual")],
        F.max(F.when(F.col("mate") == 1, F.col("name"))).alias("name"), F.count("*").alias("_n"),
    ).where("_n = 2").drop("_n")
