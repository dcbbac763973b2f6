"""Functions on read names and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncated(name: Column) -> Column:
    """Without the first character, up to the first blank or line end (a tab belongs to the name)."""
    return F.substring_index(F.substring_index(F.substr(name, F.lit(2)), " ", 1), "\n", 1)


def without_mate(name: Column) -> Column:
    return F.regexp_replace(name, "/[12]$", "")


def with_mate(name: Column, mate: int) -> Column:
    """The last character becomes the mate's number where a slash stands before it."""
    return F.regexp_replace(name, "/.$", f"/{mate}")


def synthesized(library: str, ordinal: Column) -> Column:
    return F.concat(F.lit(f"@{library}."), ordinal.cast("string"))


def mate_path(path: Column) -> Column:
    """The path with its last 1 as 2; null where there is none."""
    return F.when(F.contains(path, F.lit("1")), F.regexp_replace(path, "1([^1]*)$", "2$1"))


def sibling_path(path: Column, kind: str, suffix: str = ".archive") -> Column:
    """The file of another stream: the character after the last suffix is replaced."""
    mark = suffix.replace(".", r"\.")
    return F.regexp_replace(path, f"^(.*{mark}).", f"$1{kind}")
