"""The research memory: a table of past searches and pages with vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import quality as Q
from ..functions import text as T
from .relevance import Embed, embedded

SCHEMA = "id string, entry_type string, query string, topic string, summary string, domain string, source_type string, ts timestamp, full_result string, vector array<float>"
#: Bytes of a stored result above which it is cut and wrapped.
LARGEST = 15_000


def _limited(result: Column) -> Column:
    cut = lambda r: F.to_json(F.struct(F.substring(r, 1, LARGEST).alias("content"), F.lit(True).alias("_truncated")))
    # the result is made once, not for each use
    return F.get(F.transform(F.array(result), lambda r: F.when(F.octet_length(r) > LARGEST, cut(r)).otherwise(r)), F.lit(0))


def search_entries(rows: DataFrame, embed: Embed = embedded) -> DataFrame:
    """rows(id, query, results json, n, ts) as memory rows; embed: the model of their vectors."""
    summary = F.concat(F.lit("Search: "), F.col("query"), F.lit(" ("), F.col("n").cast("string"), F.lit(" results)"))
    kind = F.lit("search")
    return rows.select("id", kind.alias("entry_type"), "query", T.topic(F.col("query"), kind).alias("topic"), summary.alias("summary"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("source_type"), "ts", _limited(F.col("results")).alias("full_result"), embed(summary).alias("vector"))


def page_entries(rows: DataFrame, embed: Embed = embedded) -> DataFrame:
    """rows(id, url, title, preview, domain, result json, ts) as memory rows; embed: the model of their vectors."""
    summary = F.concat(F.lit("Scraped: "), F.coalesce(F.nullif("title", F.lit("")), F.col("url")), F.lit(" - "), F.col("preview"))
    kind = F.lit("scrape")
    return rows.select("id", kind.alias("entry_type"), F.col("url").alias("query"), T.topic(F.col("url"), kind).alias("topic"), summary.alias("summary"), "domain", F.lit(None).cast("string").alias("source_type"), "ts", _limited(F.col("result")).alias("full_result"), embed(summary).alias("vector"))


def append(entries: DataFrame, path: str) -> None:
    """Adds rows; the type is a partition, so that a search for one reads only that."""
    entries.select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.mode("append").partitionBy("entry_type").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table; results that are no JSON come wrapped."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    ok = F.try_parse_json("full_result").isNotNull()
    return rows.withColumn("full_result", F.when(ok | F.col("full_result").isNull(), F.col("full_result")).otherwise(F.to_json(F.struct(F.col("full_result").alias("_raw")))))


def nearest(rows: DataFrame, vector: Column, k: int, id_col: str = "id") -> DataFrame:
    """The k rows of the largest cosine, with `sim`; one partial top-k in each task, no shuffle of the rows."""
    sim = F.round(F.greatest(Q.cosine(F.col("vector"), vector), F.lit(0.0)), 6)
    return rows.withColumn("sim", sim).orderBy(F.desc("sim"), id_col).limit(k)


def hybrid(rows: DataFrame, query: str, vector: Column, k: int = 10, least: float = 0.60, entry_type: str | None = None) -> DataFrame:
    """Nearest rows, raised by the query's words in them.  The threshold holds after the limit: fewer than k rows can result."""
    if entry_type:
        rows = rows.where(F.col("entry_type") == entry_type)
    if not query.strip():
        return rows.limit(k).withColumn("score", F.lit(0.0)).withColumn("band", F.lit("Low"))
    words = query.lower().split()
    text = F.lower(F.concat_ws(" ", "query", "summary", "topic"))
    hits = sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))
    score = F.round(F.when(hits > 0, F.least(F.lit(1.0), F.col("sim") + 0.15 * hits / len(words))).otherwise(F.col("sim")), 6)
    near = nearest(rows, vector, k).withColumn("score", score)
    return near.where(F.col("score") >= least).withColumn("band", Q.match_band(F.col("score"))).orderBy(F.desc("score"), "id")


def recent_duplicate(rows: DataFrame, vector: Column, as_of: Column, hours: int = 6) -> DataFrame:
    """The nearest search of the last hours, of the five nearest ones with 0.9 or more."""
    top = nearest(rows.where(F.col("entry_type") == "search"), vector, 5).where(F.col("sim") >= 0.9)
    return top.where(F.col("ts") > as_of - F.expr(f"interval {int(hours)} hours")).orderBy(F.desc("sim"), "id").limit(1)


def is_rapid_testing(rows: DataFrame, vector: Column, as_of: Column) -> DataFrame:
    top = nearest(rows.where(F.col("entry_type") == "scrape"), vector, 3).where(F.col("sim") >= 0.95)
    return top.agg((F.count_if(F.col("ts") > as_of - F.expr("interval 5 minutes")) >= 2).alias("rapid"))


def rapid_testing_of(rows: DataFrame, vector: Column, as_of: Column, group: str) -> DataFrame:
    """is_rapid_testing for each group that has a near row: group, rapid.  Each task keeps three rows of a group before any moves."""
    sim = F.round(F.greatest(Q.cosine(F.col("vector"), vector), F.lit(0.0)), 6)
    near = rows.where(F.col("entry_type") == "scrape").select(group, "id", "ts", sim.alias("sim"))
    nth = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("sim"), "id"))
    top = near.withColumn("nth", nth).where(F.col("nth") <= 3).where(F.col("sim") >= 0.95)
    return top.groupBy(group).agg((F.count_if(F.col("ts") > as_of - F.expr("interval 5 minutes")) >= 2).alias("rapid"))


def top_domains(rows: DataFrame, k: int = 10) -> DataFrame:
    return rows.where(F.col("domain").isNotNull()).groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(k)


def stats(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("entries"), F.count("*").alias("vectors"))


def first_via(rows: DataFrame) -> DataFrame:
    """The query that first brought each URL: rows(url, query, ord)."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("url").orderBy("ord"))).where(F.col("nth") == 1).select("url", F.col("query").alias("via"))
