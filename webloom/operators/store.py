"""Tables in the folder that the cluster shares, and rows numbered over all of it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder named by spark.checkpoint.dir; only a local session may do without one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        where = tempfile.mkdtemp(prefix="webloom-")
    return f"{where.rstrip('/')}/webloom/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """df written and read back, so that it is computed once."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(rows: DataFrame, *order: str | Column, name: str = "place") -> DataFrame:
    """rows with their place, from 1, in an order of all of them.

    A range shuffle sorts them over many tasks; only a count for each task is
    gathered, and tells where the task's rows begin.
    """
    # partitions are numbered in the order's direction; a row's number within its partition is in the low 33 bits
    mark = F.monotonically_increasing_id()
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done = kept(rows.repartitionByRange(n, *cols).sortWithinPartitions(*cols).select("*", mark.alias("_mark")), "placed")
    part, nth = F.shiftright("_mark", 33), F.col("_mark").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["part"]: r["n"] for r in done.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row for each task
    before, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    start = F.element_at(F.array(*[F.lit(b).cast("long") for b in before or [0]]), (part + 1).cast("int"))
    return done.withColumn(name, start + nth + 1).drop("_mark")


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt out to all cores, where they are a table of less than one read partition for each core.

    For work that costs far more than moving its rows, such as reading pages:
    a small file is one task otherwise.  Larger tables stay where they are.
    """
    spark = rows.sparkSession
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = spark.sparkContext.defaultParallelism
    whole = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return rows.repartition(min(cores, 1 + size // (256 << 10))) if size < cores * whole else rows
