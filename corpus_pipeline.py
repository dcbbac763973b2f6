"""The corpus pipeline: each stage's result is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import readloom
from readloom.llm.common import stored
from readloom.llm.decontaminate import drop_leaks
from readloom.llm.neardup import keep_one
from readloom.llm.packing import pack_stage
from readloom.llm.quality import keep_good
from readloom.llm.secrets import mask_secrets

STAGES = [
    ("quality rules", keep_good),
    ("near duplicates", keep_one),
    ("benchmark decontamination", drop_leaks),
    ("secret scan", mask_secrets),
    ("packing", pack_stage),
]

#: Certified cutoffs, minhashing, trained forests and token ids have no SQL form: tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    readloom.ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
