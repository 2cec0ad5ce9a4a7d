"""Results kept for a while, by request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write(results: DataFrame, path: str, key: str, now: Column) -> None:
    """Replaces what is kept for a key; nothing is kept of an empty result."""
    if results.limit(1).count():
        kept = results.withColumns({"cache_key": F.md5(F.lit(key)), "cached_at": now})
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cache_key").parquet(path)


def read(spark: SparkSession, path: str, key: str, now: Column, seconds: int = 300) -> DataFrame:
    """What is kept for a key and not too old; only the key's partition is read."""
    rows = spark.read.parquet(path).where(F.col("cache_key") == F.md5(F.lit(key)))
    return rows.where(F.unix_timestamp(now) - F.unix_timestamp("cached_at") <= seconds).drop("cache_key", "cached_at")
