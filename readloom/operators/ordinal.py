"""Global places of rows in an order, without gathering them in one task."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Steps, kept

_LOCAL = (1 << 33) - 1


#: One row of so many is sampled for the bounds of ranges.
SAMPLED = 64


def _dealt(df: DataFrame, order: list[Column], by: str, n: int) -> DataFrame:
    """df in n ranges of order, as repartitionByRange deals them. That would compute every row once more for its sample; here
    the sample is a condition on a column, so that only its rows are computed. Bounds that fit badly cost balance, no more."""
    key = F.struct(*[c.alias(f"_{k}") for k, c in enumerate(order)])
    with Steps(df.sparkSession) as steps:  # the sample is stored, since it is read twice to be dealt
        some = steps.kept(df.where(F.pmod(F.xxhash64(by), F.lit(SAMPLED)) == 0).select(key.alias("k")), "sample")
        least = some.repartitionByRange(n, "k").groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("k")).collect()  # a row a range
    bounds = [r.k for r in sorted(least, key=lambda r: r.p)][1:]
    if not bounds:
        return df.repartitionById(n, F.lit(0))
    types = [f.dataType for f in some.schema["k"].dataType]

    def place(lo: int, hi: int) -> Column:
        """How many bounds do not exceed the key, by halves; the first column mostly tells."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        bound = [F.lit(v).cast(t) for v, t in zip(bounds[mid], types, strict=True)]
        below = F.when(order[0] < bound[0], True).when(order[0] > bound[0], False).otherwise(key < F.struct(*[x.alias(f"_{k}") for k, x in enumerate(bound)]))
        return F.when(below, place(lo, mid)).otherwise(place(mid + 1, hi))

    return df.repartitionById(n, place(0, len(bounds)))


def with_ordinal(df: DataFrame, *order: str | Column, name: str = "ordinal", by: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Adds the place of each row, from 0. Ranges of rows are sorted apart; a range's rows come after those of
    the ranges before it, whose counts (a number a range) are summed on the driver. by: a column with many values that a
    condition can be put on where df is read. columns: those to keep, by default all."""
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by_key = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = (df.repartitionByRange(n, *by_key) if by is None else _dealt(df, by_key, by, n)).sortWithinPartitions(*by_key)
    dealt = dealt if columns is None else dealt.select(*columns)
    placed = kept(dealt.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL))), "ranges", "zstd")
    before, at = [(-1, 0)], 0
    for r in sorted(placed.groupBy("_range").count().collect(), key=lambda r: r["_range"]):
        before.append((r["_range"], at))
        at += r["count"]
    columns = [pa.array(x, kind) for x, kind in zip(zip(*before, strict=True), (pa.int32(), pa.int64()), strict=True)]
    starts = spark.createDataFrame(pa.table(columns, names=["_range", "_first"]))  # of Arrow, since a list would start a Python worker on every core
    return placed.join(F.broadcast(starts), "_range").withColumn(name, F.col("_first") + F.col("_at")).drop("_range", "_at", "_first")
