"""Extraction cache: appended rows by content key and extractor version, the last one wins."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.functions.keys import cache_key
from citeweave.operators.resolve import last_wins

SCHEMA = "key string, version string, surname string, year int, title string, written_at timestamp"


def append(rows: DataFrame, path: str, version: str) -> None:
    """Adds extracted rows(cleaned, surname, year, title)."""
    rows.select(cache_key(F.col("cleaned")).alias("key"), F.lit(version).alias("version"), "surname", "year", "title", F.current_timestamp().alias("written_at")).write.mode("append").parquet(path)


def read(spark: SparkSession, path: str, version: str) -> DataFrame:
    """The last row of each key under a version; none without a cache."""
    try:
        rows = spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], SCHEMA)
    return last_wins(rows.where(F.col("version") == version).drop("version"), "key", "written_at")


def split(cleaned: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with their cached fields, misses) of rows(cleaned)."""
    keyed = cleaned.withColumn("key", cache_key(F.col("cleaned")))
    return keyed.join(cached.drop("written_at"), "key"), keyed.join(cached, "key", "left_anti")
