"""Reads the test tables of a data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relation_letters(c: Column) -> Column:
    """A relation's letters: spellings differ only in case and in what stands between the words."""
    return F.regexp_replace(F.lower(c), "[^a-z]", "")
