"""What the operators of this subpackage share: tables, and stored steps under names of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..storage import Steps, deleted, freed_shuffles
from ..storage import kept as stored
from ..storage import shared_path as shared_dir

__all__ = ["SEPARATORS", "Steps", "deleted", "freed_shuffles", "shared_dir", "stored", "table"]

#: ASCII white space that separates words everywhere in this subpackage, as a Java/Python class body.
SEPARATORS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df
