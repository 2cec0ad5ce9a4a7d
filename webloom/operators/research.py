"""Research over several queries: candidates, filters, order, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import tables
from ..functions import text as T
from ..functions import url as U
from . import store


def is_spam(title: Column, content: Column, url: Column) -> Column:
    text = F.lower(F.concat_ws("\n", title, content, url))
    return T.has_any(text, tables.SPAM_MARKERS)


def by_priority(results: DataFrame) -> DataFrame:
    """results(url, rank) with `place`: sites that research prefers first, else in rank."""
    return store.placed(results.withColumn("priority", U.domain_priority(F.col("url"))), F.desc("priority"), "rank", "url")


def logged_urls(logs: DataFrame, limit: int = 10) -> DataFrame:
    """logs(id, json) as id, urls: of a list, or of an object's all_urls, top_sources or key_findings; each once."""
    j = F.try_parse_json("json")
    strings = lambda path: F.coalesce(F.try_variant_get(j, path, "array<string>"), F.array().cast("array<string>"))
    objects = lambda path: F.coalesce(F.transform(F.try_variant_get(j, path, "array<struct<url:string>>"), lambda x: x["url"]), F.array().cast("array<string>"))
    every = F.concat(objects("$"), strings("$"), strings("$.all_urls"), objects("$.all_urls"), strings("$.top_sources"), objects("$.top_sources"), objects("$.key_findings"))
    ok = F.filter(every, lambda u: u.isNotNull() & F.startswith(u, F.lit("http")))
    return logs.select("id", F.slice(F.array_distinct(ok), 1, limit).alias("urls"))


def unseen(candidates: DataFrame, seen: DataFrame, limit: int) -> DataFrame:
    """The first candidates(url, ord) that are not in seen(url), each once."""
    new = candidates.join(seen.select("url"), "url", "left_anti").groupBy("url").agg(F.min("ord").alias("ord"))
    return new.orderBy("ord", "url").limit(limit)


def bucket_hits(findings: DataFrame, most: int = 3) -> DataFrame:
    """section, nth, url, title: the first findings(ord, url, title, content) of each section of a report."""
    said = F.concat_ws(" ", F.lower("title"), F.lower("url"), F.lower("content"))
    findings = findings.select("ord", "url", "title", said.alias("said"))  # once, not for each word looked for
    hit = F.array(*[F.when(T.has_any(F.col("said"), w), F.struct(F.lit(i).alias("no"), F.lit(s).alias("section"))) for i, (s, w) in enumerate(tables.REPORT_SECTIONS.items())])
    each = findings.select("ord", "url", "title", F.explode(F.filter(hit, lambda h: h.isNotNull())).alias("h"))
    rank = F.row_number().over(Window.partitionBy("h.no").orderBy("ord"))
    return each.withColumn("nth", rank).where(F.col("nth") <= most).select("h.no", "h.section", "nth", "url", "title")


def report(findings: DataFrame, query: str) -> DataFrame:
    """One row `report`: a fact sheet in markdown of findings(ord, url, title, content, depth, word_count); none without findings."""
    link = F.concat(F.lit("- ["), F.col("title"), F.lit("]("), F.col("url"), F.lit(")"))
    lines = bucket_hits(findings).groupBy("section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", link.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    section = lines.agg(F.map_from_entries(F.collect_list(F.struct("section", "lines"))).alias("by"))
    source = F.concat(link, F.lit(" (depth="), F.col("depth").cast("string"), F.lit(", ~"), F.col("word_count").cast("string"), F.lit(" words)"))
    top = findings.orderBy("ord").limit(5).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", source.alias("line")))), lambda x: x["line"]), "\n").alias("top"))
    n = findings.agg(F.count("*").alias("n"))
    part = lambda s: F.concat(F.lit(f"\n## {s}\n"), F.coalesce(F.try_element_at("by", F.lit(s)), F.lit("- _(no relevant sources found)_")), F.lit("\n"))
    body = F.concat(F.lit(f"# Fact-Sheet (heuristic_v1)\n\n**Query:** {query}\n**Sources scraped:** "), F.col("n").cast("string"), F.lit("\n"), *[part(s) for s in tables.REPORT_SECTIONS], F.lit("\n## Top Sources\n"), F.col("top"), F.lit("\n"))
    # three tables of one row each
    return n.where(F.col("n") > 0).join(F.broadcast(section)).join(F.broadcast(top)).select(body.alias("report"))
