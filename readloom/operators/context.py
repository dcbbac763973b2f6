"""Order-1 and order-2 statistics of the quality stream, and the coder's model made of them.

The stream is the reads' symbols one after the other, so contexts cross from one read into the next. Within a
read they are counted in place; for the two first symbols of a read the last two of the read before it are
joined on. Reads have at least two symbols.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordinal import with_ordinal

#: Symbols of the model run from 0 to DEPTH - 1.
DEPTH = 80
LARGEST = 2**32 - 1


def streams(reads: DataFrame, values: Column, order: str = "read_id") -> DataFrame:
    """One row a read: v, the two symbols before it (or fewer, at the start) and its own."""
    rows = with_ordinal(reads.select(order, values.alias("q")), order)
    tails = rows.select((F.col("ordinal") + 1).alias("ordinal"), F.slice("q", -2, 2).alias("tail"))
    return rows.join(tails, "ordinal", "left").select(F.concat(F.coalesce("tail", F.array().cast("array<int>")), F.col("q").cast("array<int>")).alias("v"), F.coalesce(F.size("tail"), F.lit(0)).alias("lead"))


def order1(stream: DataFrame) -> DataFrame:
    """(p1, v, n): how often v follows p1."""
    v = F.col("v")
    pairs = F.when(F.size("v") > 1, F.transform(F.sequence(F.greatest(F.col("lead") - 1, F.lit(0)), F.size("v") - 2), lambda i: F.struct(F.get(v, i).alias("p1"), F.get(v, i + 1).alias("v"))))
    return stream.select(F.explode(pairs).alias("x")).groupBy("x.p1", "x.v").agg(F.count("*").alias("n"))


def order2(stream: DataFrame) -> DataFrame:
    """(p2, p1, v, n): how often v follows p2, p1."""
    v = F.col("v")
    triples = F.when(F.size("v") > 2, F.transform(F.sequence(F.lit(0), F.size("v") - 3), lambda i: F.struct(F.get(v, i).alias("p2"), F.get(v, i + 1).alias("p1"), F.get(v, i + 2).alias("v"))))
    return stream.select(F.explode(triples).alias("x")).groupBy("x.p2", "x.p1", "x.v").agg(F.count("*").alias("n"))


def smoothed(counts: DataFrame, depth: int = DEPTH, largest: int = LARGEST) -> DataFrame:
    """All depth**3 contexts, each count one more than seen, scaled down to a total of at most largest, but not to 0."""
    spark = counts.sparkSession
    n = spark.range(depth**3).select(
        (F.col("id") / (depth * depth)).cast("int").alias("p2"), ((F.col("id") / depth).cast("int") % depth).alias("p1"), (F.col("id") % depth).cast("int").alias("v"),
    )
    full = n.join(counts, ["p2", "p1", "v"], "left").select("p2", "p1", "v", (F.coalesce("n", F.lit(0)) + 1).alias("n"))
    total = full.agg(F.sum("n").alias("total"))
    return full.crossJoin(F.broadcast(total)).select("p2", "p1", "v", F.greatest(F.lit(1), F.expr(f"n div (1 + total div {largest})")).alias("n"))  # one row


def cumulative(counts: DataFrame) -> DataFrame:
    """Adds the interval [lo, hi) of each symbol in its context."""
    w = Window.partitionBy("p2", "p1").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("hi", F.sum("n").over(w)).withColumn("lo", F.col("hi") - F.col("n")).select("p2", "p1", "v", "n", "lo", "hi")


def entropy_bits(counts: DataFrame) -> DataFrame:
    """Bits that an ideal coder with these counts spends on the stream, and the symbols coded."""
    totals = counts.groupBy("p2", "p1").agg(F.sum("n").alias("t"))
    joined = counts.join(totals, ["p2", "p1"])
    return joined.agg(F.sum(F.col("n") * F.log2(F.col("t") / F.col("n"))).alias("bits"), F.sum("n").alias("symbols"))
