"""Filters and checks of reads, and of options."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def non_empty(reads: DataFrame) -> DataFrame:
    return reads.where(F.length("seq") > 0)


def length_violations(reads: DataFrame) -> DataFrame:
    """Reads whose length is not that of the first read."""
    first = reads.agg(F.min_by(F.length("seq"), "read_id").alias("expected"))
    return reads.crossJoin(F.broadcast(first)).where(F.length("seq") != F.col("expected")).select("read_id", F.length("seq").alias("length"), "expected")  # one row


def require_fixed_length(reads: DataFrame) -> DataFrame:
    """reads, failing while they are read where a length differs."""
    first = reads.agg(F.min_by(F.length("seq"), "read_id").alias("_n"))
    ok = reads.crossJoin(F.broadcast(first))  # one row
    checked = F.when(F.length("seq") == F.col("_n"), F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("length of read "), F.col("read_id").cast("string"), F.lit(" differs"))))
    return ok.withColumn("seq", checked).drop("_n")


def size_in_bytes(text: str) -> int:
    """A whole number with M or G."""
    found = re.fullmatch(r"([0-9]+)([MG])", text.strip())
    if not found:
        raise ValueError(f"{text!r}: a number with M or G is asked for, such as 4G")
    return int(found[1]) << (20 if found[2] == "M" else 30)


def mate_file(path: str) -> str | None:
    head, found, tail = path.rpartition("1")
    return f"{head}2{tail}" if found else None


def validated(*, inputs: list[str], output: str | None, percent: int = 0, decode: bool = False, paired: bool = False, library: str | None = None, drop_names: bool = False) -> None:
    """Raises ValueError on options that make no sense together."""
    problems = [
        (not 0 <= percent <= 100, "the lossy percentage lies between 0 and 100"),
        (not output, "an output is needed"),
        (not inputs, "an input is needed"),
        (drop_names and not library, "without names a library name is needed"),
        (decode and len(inputs) > 1, "one archive at a time is decoded"),
        (decode and output == "-" and paired, "a pair can't be written to standard output"),
    ]
    for wrong, text in problems:
        if wrong:
            raise ValueError(text)
    for path in inputs if paired and not decode else []:
        mate = mate_file(path)
        if mate is None or (os.path.isabs(path) and not os.path.exists(mate)):
            raise ValueError(f"{path}: no mate file")


