"""Bins of reads with one core: their order, the order within them, their sizes, runs and parts.

Bins go by length of the core, then by the core; reads without a core come last. Within a bin reads go by the
bases after the core, filled up with A, then by read_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bases import sort_key
from ..functions.names import truncated
from .ordinal import with_ordinal


def bin_columns() -> list[Column]:
    return [F.col("core").isNull(), F.length("core"), F.col("core")]


def keyed(found: DataFrame) -> DataFrame:
    return found.withColumn("sort_key", sort_key(F.col("seq"), F.coalesce("core", F.lit("")), F.col("core_end"), F.length("seq")))


def clustered(found: DataFrame, ordinal: str = "place", columns: list[str] | None = None, by: str = "read_id") -> DataFrame:
    """Reads in archive order with their place from 0. Ranges take the sort key in, so a large bin is split.
    columns: those to keep, by default all; only what they and the order need is dealt. by: see with_ordinal."""
    rows = keyed(found)
    if columns is not None:
        rows = rows.select(*dict.fromkeys([*columns, "core", "sort_key", "read_id", by]))
    return with_ordinal(rows, *bin_columns(), F.col("sort_key"), F.col("read_id"), name=ordinal, by=by, columns=columns)


#: What clustered_by_rank orders by: _rank, the number of the bin in their order and then the first RANKED bases of the sort key in two bits each;
#: _key, the sort key packed, which fills it up with A; _width, its length; so they rise as bin_columns and the sort key do.
RANK, RANKED = ["_rank", "_key", "_width"], 16


def clustered_by_rank(found: DataFrame, columns: list[str], ordinal: str = "place", by: str = "read_id") -> DataFrame:
    """clustered, of reads that know their RANK: it is shorter than cores and keys, and quicker to compare."""
    return with_ordinal(found.select(*dict.fromkeys([*columns, *RANK, "read_id", by])), *RANK, "read_id", name=ordinal, by=by, columns=columns)


def bin_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("core_id", "core").agg(F.count("*").alias("n_reads"))


def bin_order(found: DataFrame) -> DataFrame:
    """Bins with their place from 0."""
    return with_ordinal(bin_counts(found), *bin_columns(), name="bin")


def bin_stats(found: DataFrame) -> DataFrame:
    """Per bin: reads and bytes of names, packed reads with a marker of the core's end, and qualities."""
    length = F.length("seq")
    marker = F.when(length <= 255, 1).otherwise(2)
    kept = length - F.coalesce(F.length("core"), F.lit(0))
    return found.groupBy("core_id", "core").agg(
        F.count("*").alias("n_reads"),
        F.sum(F.octet_length(truncated(F.col("name"))) + 1).alias("bytes_names"),
        F.sum(F.ceil(kept / 4) + marker).alias("bytes_reads"),
        F.sum(F.coalesce(F.octet_length("qual"), F.lit(0))).alias("bytes_quals"),
    )


def bucketed_summary(found: DataFrame) -> DataFrame:
    return found.agg(
        F.count("*").alias("n_reads"), F.count("core").alias("n_bucketed"),
        F.round(F.count("core") * 100.0 / F.count("*"), 6).alias("percent"), F.max(F.length("seq")).alias("read_length"),
    )


def merged(runs: list[DataFrame]) -> DataFrame:
    """Runs as one sorted whole."""
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return clustered(out)


def parts(placed: DataFrame, size: int, place: str = "place") -> DataFrame:
    """Part (from 1) of size rows each, and the row's place in it."""
    return placed.withColumn("part", F.expr(f"{place} div {size}").cast("int") + 1).withColumn("at", F.expr(f"{place} % {size}"))


def rank_in_bin(found: DataFrame) -> DataFrame:
    """Place within the bin from 0, from global places: the first place of each bin is a small aggregate."""
    placed = clustered(found, columns=["read_id", "core_id", "sort_key"])
    first = placed.groupBy(F.coalesce("core_id", F.lit(-1)).alias("b")).agg(F.min("place").alias("first"))
    return placed.withColumn("b", F.coalesce("core_id", F.lit(-1))).join(first, "b").withColumn("at", F.col("place") - F.col("first")).drop("b", "first")


