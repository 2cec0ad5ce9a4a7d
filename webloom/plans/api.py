"""The public entry points: search, fetch, crawl, extract, memory, research."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fields as X
from ..functions import text as T
from ..functions import url as U
from ..operators import crawl as C
from ..operators import extract as E
from ..operators import memory as M
from ..operators import relevance as R
from ..operators import research as D
from ..operators import search as S
from ..operators import store
from ..sources import pages as P


def web_search(results: DataFrame, query: str, as_of: Column, max_results: int = 10) -> DataFrame:
    """Engine rows (see operators.search.merged) to at most max_results: merged, scored, reranked, distinct."""
    best = S.reranked(S.boosted(S.scored(S.merged(results), query, as_of), query), query)
    return S.distinct_by_signature(best, "rank").orderBy("rank").limit(max_results)


def search_structured(results: DataFrame, pages: DataFrame, query: str, as_of: Column, max_results: int = 10, top_n: int = 3) -> DataFrame:
    """web_search with the content of the first top_n pages."""
    found = web_search(results, query, as_of, max_results)
    content = P.scored(P.parsed(pages.join(found.where(F.col("rank") <= top_n).select("url"), "url", "left_semi"), P.SCORED)).select("url", "clean_content")
    return found.join(content, "url", "left")


def web_fetch(pages: DataFrame, urls: DataFrame, query: str | None = None, max_chars: int = 10_000, strict: bool | None = None, threshold: float = 0.35, embed: R.Embed | None = None) -> DataFrame:
    """Pages of urls(url); strict, as it is with a query unless told otherwise, shaves long ones to the query."""
    got = P.fetched(urls, pages, max_chars)
    strict = bool(query) if strict is None else strict
    return R.gated(got, query, threshold, embed=embed) if strict else got


def batch_summary(fetched: DataFrame) -> DataFrame:
    return fetched.agg(F.count("*").alias("total"), F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed"))


def crawl_website(spark: SparkSession, pages: DataFrame, start: str, **limits) -> DataFrame:
    return C.crawl(spark, pages.select("page_id", "url", "html"), start, **limits)


def extract_fields(pages: DataFrame, schema: list[X.Field] | str, strict: bool = True) -> DataFrame:
    """Fields named by a schema, or by a request in words."""
    fields = X.schema_from_prompt(schema) if isinstance(schema, str) else schema
    rows = P.scored(P.parsed(pages, P.SCORED))
    return E.extracted(rows, fields, strict) if fields else E.auto(rows)


def memory_search(rows: DataFrame, query: str, limit: int = 10, threshold: float = 0.60, entry_type: str | None = None, embed: R.Embed = R.embedded) -> DataFrame:
    """Rows like a query; embed: the model that made the rows' vectors."""
    return M.hybrid(rows, query, embed(F.lit(query)), limit, threshold, entry_type)


def deep_research(results: DataFrame, pages: DataFrame, query: str, as_of: Column, depth: int = 1, max_sources: int = 10, max_chars: int = 20_000, threshold: float = 0.25) -> DataFrame:
    """Findings: ord, url, title, content, depth, word_count, via.

    results: engine rows with `query`, the angle that brought them.  The first
    hop takes the best results without marketing pages; each further hop the
    links of the pages before it that are not seen yet.
    """
    depth, max_sources = max(1, min(depth, 3)), max(1, min(max_sources, 20))
    best = S.reranked(S.boosted(S.scored(S.merged(results), query, as_of), query), query)
    best = best.where(~D.is_spam(F.col("title"), F.col("content"), F.col("url")))
    wave = store.kept(D.by_priority(best.select("url", "rank")).orderBy("place").limit(2 * max_sources).select("url", F.col("place").alias("ord")), "wave")
    via = M.first_via(results.select("url", "query", "ord"))
    hops, seen = [], wave.select("url")
    for hop in range(1, depth + 1):
        # a hop's pages are a few dozen: read once, kept for the links and the text
        got = store.kept(P.scored(P.parsed(pages.join(F.broadcast(wave.select("url")), "url", "left_semi"), [*P.SCORED, "links"])).join(F.broadcast(wave), "url").select("ord", "url", "title", "clean_content", "word_count", "links"), "hop")
        hops.append(got.select("ord", "url", "title", F.substring("clean_content", 1, max_chars).alias("content"), F.lit(hop).alias("depth"), "word_count"))
        if hop < depth:
            links = got.select("ord", F.posexplode("links").alias("at", "l")).select(F.col("l.url").alias("url"), (F.col("ord") * 1000 + F.col("at")).alias("ord"))
            wave = store.kept(D.unseen(links.where(U.is_http(F.col("url"))), seen, 3 * max_sources), "wave")
            seen = seen.unionByName(wave.select("url"))
    found = hops[0]
    for h in hops[1:]:
        found = found.unionByName(h)
    short = R.shaved(found.select(F.col("url").alias("id"), F.col("content").alias("text")), query, threshold).select(F.col("id").alias("url"), F.col("text").alias("content"))
    found = found.drop("content").join(short, "url").join(via, "url", "left")
    order = Window.orderBy("depth", F.desc("word_count"), "url")
    return found.withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= max_sources)


def memory_candidates(rows: DataFrame, query: str, as_of: Column, budget: int = 20) -> DataFrame:
    """URLs that past searches know for a query, before a new search: url, via, ord.

    Those of a near duplicate of the last three days; if it has none, those of
    like searches, told whether their query was the same.
    """
    vector = R.embedded(F.lit(query))
    recent = M.recent_duplicate(rows, vector, as_of, 72).select("id", F.col("full_result").alias("json"))
    first = D.logged_urls(recent, budget).select(F.posexplode("urls").alias("ord", "url")).select("url", F.lit("memory_duplicate").alias("via"), "ord")
    if first.limit(1).count():
        return first
    like = M.hybrid(rows, query, vector, max(12, budget), 0.55, "search")
    ranked = like.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    urls = D.logged_urls(ranked.select("id", F.col("full_result").alias("json")), budget)
    via = F.when(T.normalized_query(F.col("query")) == T.normalized_query(F.lit(query)), "memory_exact").otherwise("memory_history")
    each = ranked.select("id", "place", via.alias("via")).join(urls, "id").select("via", "place", F.posexplode("urls").alias("at", "url"))
    best = each.groupBy("url").agg(F.min(F.struct("place", "at", "via")).alias("b")).orderBy("b").limit(budget)
    return best.select("url", F.col("b.via").alias("via"), F.row_number().over(Window.orderBy("b")).alias("ord"))


def clean_json(fetched: DataFrame, max_chars: int = 10_000) -> DataFrame:
    """fetched pages as url, title, paragraphs, key_points: paragraphs long enough and without boilerplate, and their first sentences."""
    from .. import tables

    least = F.when(F.col("word_count") < 200, 3).otherwise(8)
    paragraphs = F.filter(F.split("clean_content", "\\n\\n"), lambda p: (T.word_count(p) >= least) & ~T.has_any(F.lower(p), tables.BOILERPLATE))
    first = lambda p: F.regexp_extract(p, "^(.+?[.!?])(?:\\s|$)", 1)
    points = F.filter(F.transform(paragraphs, first), lambda s: T.word_count(s) >= 4)
    return fetched.select("url", "title", T.paragraphs_within(paragraphs, max_chars).alias("paragraphs"), points.alias("key_points"))
