"""Functions on quality strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def symbols(qual: Column) -> Column:
    """The characters' codes, in order."""
    return F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: F.ascii(c))


def error_probability(symbol: Column, offset: Column) -> Column:
    return F.pow(F.lit(10.0), -(symbol - offset) / F.lit(10.0))


def remapped(values: Column, mapping: Column) -> Column:
    """Each code by its replacement in mapping (map<int,int>); codes that it lacks stay."""
    return F.transform(values, lambda v: F.coalesce(mapping[v], v))


def rebased(values: Column, offset: Column) -> Column:
    return F.transform(values, lambda v: v - offset)


def masked(bases: Column, values: Column) -> Column:
    """Rebased values with 0 at every N."""
    return F.zip_with(F.filter(F.split(bases, ""), lambda c: c != ""), values, lambda b, v: F.when(b == "N", 0).otherwise(v))


def with_unknown(bases: Column, values: Column) -> Column:
    """The bases with N wherever the value is 0."""
    return F.array_join(F.zip_with(F.filter(F.split(bases, ""), lambda c: c != ""), values, lambda b, v: F.when(v == 0, "N").otherwise(b)), "")


def text(values: Column, offset: Column) -> Column:
    """The quality string of rebased values."""
    return F.array_join(F.transform(values, lambda v: F.char(v + offset)), "")
