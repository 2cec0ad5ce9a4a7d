"""Results of several engines: merged by URL, scored, ordered, made distinct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U


def _first_filled(name: str, blank: bool = False) -> Column:
    """Value of the first row, in order, that has one."""
    ok = F.trim(name) != "" if blank else F.col(name).isNotNull()
    return F.min_by(F.when(ok, F.col(name)), F.when(ok, F.col("ord")))


#: What only some engines give: an answer of their own, facts beside a result, a corrected query.
EXTRAS = ["rich_snippet", "top_answer", "query_rewrite"]


def merged_extras(extras: DataFrame) -> DataFrame:
    """extras(ord, related, suggestions, warnings, rewrite, answer) of each engine in one row: lists one after the other, the first rewrite and answer."""
    lists = lambda n: F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ord", n))), lambda x: F.coalesce(x[n], F.array().cast("array<string>")))).alias(n)
    return extras.agg(*map(lists, ("related", "suggestions", "warnings")), *[_first_filled(n).alias(n) for n in ("rewrite", "answer")])


def merged(results: DataFrame) -> DataFrame:
    """One row for each address.  results(ord, engine, url, title, content, published_at, domain, source_type, breadcrumbs), ord their order.

    A partial aggregation: rows of one address meet as sums, not as a group.
    Columns of results named in EXTRAS keep the first value that there is.
    """
    extras = [(n, _first_filled(n)) for n in EXTRAS if n in results.columns]
    r = results.withColumn("url_key", U.search_key(F.col("url")))
    m = r.groupBy("url_key").agg(
        F.min("ord").alias("ord"),
        F.min_by("url", "ord").alias("url"),
        F.coalesce(_first_filled("title", True), F.lit("")).alias("title"),
        F.coalesce(_first_filled("content", True), F.lit("")).alias("content"),
        _first_filled("published_at").alias("published_at"),
        _first_filled("domain").alias("domain"),
        _first_filled("source_type").alias("source_type"),
        F.sort_array(F.collect_set("engine")).alias("engines"),
        *[c.alias(n) for n, c in extras],
    )
    # each path of an address once, however many rows have it
    paths = r.groupBy(F.col("url_key").alias("k"), "breadcrumbs").agg(F.min("ord").alias("ord"))
    m = m.join(paths.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("ord", "breadcrumbs"))).alias("crumbs")), F.col("k") == F.col("url_key"), "left").drop("k")
    # an ordered union without regard to case
    union = F.aggregate(
        F.flatten(F.col("crumbs.breadcrumbs")),
        F.array().cast("array<string>"),
        lambda have, c: F.when(F.exists(have, lambda h: F.lower(h) == F.lower(c)), have).otherwise(F.concat(have, F.array(c))),
    )
    label = F.when(F.size("engines") > 1, F.concat(F.lit("multi:"), F.array_join("engines", ","))).otherwise(F.get("engines", F.lit(0)))
    return m.withColumn("breadcrumbs", union).withColumn("engine", label).drop("crumbs")


def scored(results: DataFrame, query: str, as_of: Column) -> DataFrame:
    """merged() rows with `score`: trust in the site, agreement of engines, recency."""
    topic = T.query_topic(F.lit(query))
    trust = U.domain_weight(F.col("domain"), F.col("source_type"), topic) * F.when(U.has_high_value_crumb(F.col("breadcrumbs")), 1.20).otherwise(1.0)
    score = trust + 0.35 * (F.size("engines") - 1) + T.recency_bonus(T.parsed_date(F.col("published_at")), as_of)
    return results.withColumn("score", F.round(score, 6))


def boosted(results: DataFrame, query: str) -> DataFrame:
    """With `early`, the score raised by a fifth for each query word in the first 200 characters; it only orders."""
    start = F.lower(F.substring("content", 1, 200))
    hits = sum((F.contains(start, F.lit(t)).cast("int") for t in T.query_tokens(query)), F.lit(0))
    return results.withColumn("early", F.round(F.col("score") * (1 + 0.2 * hits), 6))


def reranked(results: DataFrame, query: str, top: int = 50, threshold: float | None = None) -> DataFrame:
    """The `top` results by relevance to the query, ties in their order by `early`, then by address; with `rank` from 1."""
    r = results.withColumn("relevance", T.relevance(T.query_tokens(query), F.col("title"), F.col("content")))
    if threshold is not None:
        r = r.where(F.col("relevance") >= threshold)
    best = r.orderBy(F.desc("relevance"), F.desc("early"), "url_key").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("relevance"), F.desc("early"), "url_key")))


def distinct_by_signature(results: DataFrame, order: str, chars: int = 140) -> DataFrame:
    """The first of the rows, by `order`, that agree in title and beginning of the content."""
    row = F.min_by(F.struct(*results.columns), order).alias("row")  # a partial aggregation: no signature's rows are gathered
    return results.groupBy(T.signature(F.col("title"), F.col("content"), chars).alias("signature")).agg(row).select("row.*")


def duplicates_removed(results: DataFrame, chars: int = 140) -> DataFrame:
    s = T.signature(F.col("title"), F.col("content"), chars)
    return results.agg(F.count("*").alias("total"), F.countDistinct(s).alias("kept")).select("total", "kept", (F.col("total") - F.col("kept")).alias("removed"))


def run_labels(runs: DataFrame) -> DataFrame:
    """runs(engine, status, reason) as lists of unresponsive, degraded and skipped engines."""
    label = F.concat(F.col("engine"), F.lit(":"), F.coalesce("reason", F.lit("")))
    some = lambda *status: F.sort_array(F.collect_set(F.when(F.col("status").isin(*status), label)))
    return runs.agg(some("blocked", "timeout", "failed").alias("unresponsive"), some("recovered").alias("degraded"), some("skipped").alias("skipped"))
