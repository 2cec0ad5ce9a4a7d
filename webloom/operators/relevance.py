"""Long texts cut to what a query asks for: by chunks, by sections."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import quality as Q
from ..functions import text as T
from . import store

DIMENSIONS = 64


def embedded(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """A vector of a text without a model: counts of its tokens by hash.  Stands in wherever a trained embedding is not given."""
    at = F.transform(T.tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(dimensions)))
    counts = lambda hashes: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.size(F.filter(hashes, lambda a: a == i)).cast("float"))
    # the text is split once, not for each dimension
    return F.get(F.transform(F.array(at), counts), F.lit(0))


def chunked(docs: DataFrame, window: int = 200, stride: int = 100) -> DataFrame:
    """docs(id, text) as id, chunk (from 0), text."""
    d = docs.select("id", "text", T.words(F.col("text")).alias("w"))
    return d.select("id", F.posexplode(T.chunks(F.col("text"), window, stride, F.col("w"))).alias("chunk", "text"))


#: A model: from a column of texts to their vectors (a pandas UDF, say).
Embed = Callable[[Column], Column]


def likeness(text: Column, query: str, dimensions: int | None = DIMENSIONS, spark: SparkSession | None = None) -> Column:
    """Cosine of a text's vector and the query's, both of embedded() and six decimals long, within the row.

    The text's hashes are sorted, so that one pass over them counts each; without
    dimensions whole hashes count, and a text without a word of the query has 0.
    """
    at = lambda t: F.xxhash64(t) if dimensions is None else F.pmod(F.xxhash64(t), F.lit(dimensions).cast("long"))
    spark = spark or SparkSession.active()
    q = Counter(spark.range(1).select(F.transform(T.tokens(F.lit(query)), at).alias("q")).first()["q"])  # the query's few tokens
    norm = math.sqrt(sum(n * n for n in q.values()))
    if not q:
        return F.lit(0.0)
    worth = F.create_map(*[F.lit(x).cast(k) for d, n in q.items() for x, k in ((d, "long"), (n, "double"))])
    none = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("squares"), F.lit(0.0).alias("dot"))

    def counted(s: Column, x: Column) -> Column:
        run = F.when(s["last"].eqNullSafe(x), s["run"]).otherwise(0.0)
        dot = s["dot"] + F.coalesce(F.try_element_at(worth, x), F.lit(0.0))
        return F.struct(x.alias("last"), (run + 1.0).alias("run"), (s["squares"] + 2.0 * run + 1.0).alias("squares"), dot.alias("dot"))

    cosine = lambda s: F.when(s["squares"] > 0, s["dot"] / (F.sqrt(s["squares"]) * norm)).otherwise(0.0)
    return F.round(F.coalesce(F.aggregate(F.sort_array(F.transform(T.tokens(text), at)), none, counted, cosine), F.lit(0.0)), 6)


def near(parts: DataFrame, query: str, embed: Embed | None = None) -> DataFrame:
    """parts(text, ...) with `sim`, the cosine of a text's vector and the query's; vectors are embed's, or else those of embedded()."""
    if embed is None:
        return parts.withColumn("sim", likeness(F.col("text"), query, spark=parts.sparkSession))
    return parts.withColumn("sim", F.round(Q.cosine(embed(F.col("text")), embed(F.lit(query))), 6))


def shaved(docs: DataFrame, query: str, threshold: float = 0.35, embed: Embed | None = None, dimensions: int | None = DIMENSIONS) -> DataFrame:
    """docs(id, text) with the chunks near the query: id, text, kept, total.

    Chunks of at least the threshold stay, in order; if there are none, the best
    one (of equal ones the last).  The text stays as it is where it is one
    chunk, or where the chunks, which overlap, would be longer; `kept` still
    tells how many were near.  Rows may share an id.  Without a model a text's
    chunks stay in its row, by vectors of embedded() of these dimensions.
    """
    if embed is None:
        return _shaved_in_rows(docs, threshold, lambda text: likeness(text, query, dimensions, docs.sparkSession))
    docs = _keyed(docs)
    each = near(chunked(docs).withColumnRenamed("chunk", "at"), query, embed).withColumnRenamed("at", "chunk")
    by = each.groupBy("id").agg(
        F.sort_array(F.collect_set(F.when(F.col("sim") >= threshold, F.struct("chunk", "text")))).alias("near"),
        F.max_by("text", F.struct("sim", "chunk")).alias("best"),
        (F.max("chunk") + 1).alias("total"),
    )
    joined = F.when(F.size("near") > 0, F.array_join(F.col("near.text"), "\n\n")).otherwise(F.col("best"))
    by = by.select(F.col("id").alias("_id"), joined.alias("short"), F.greatest(F.size("near"), F.lit(1)).alias("near_n"), "total")
    both = docs.select("id", "text").join(by, F.col("_id").eqNullSafe(F.col("id")), "left")
    use = (F.col("total") > 1) & (F.octet_length("short") <= F.octet_length("text"))
    kept = F.when(F.col("total") > 1, F.col("near_n")).otherwise(F.col("total"))
    return both.select("id.id", F.when(use, F.col("short")).otherwise(F.col("text")).alias("text"), kept.cast("long").alias("kept"), F.col("total").cast("long").alias("total"))


def _shaved_in_rows(docs: DataFrame, threshold: float, sim: Callable[[Column], Column]) -> DataFrame:
    """shaved() without a shuffle; sim: how near a chunk is."""
    d = store.spread(docs.select("id", "text")).select("id", "text", T.words(F.col("text")).alias("_w"))
    d = d.select("id", "text", T.chunks(F.col("text"), 200, 100, F.col("_w")).alias("_parts"))
    d = d.select("id", "text", F.transform("_parts", lambda p, i: F.struct(sim(p).alias("sim"), i.alias("at"), p.alias("text"))).alias("_parts"))
    total = F.nullif(F.size("_parts"), F.lit(0))
    d = d.select("id", "text", F.filter("_parts", lambda p: p["sim"] >= threshold).alias("_near"), F.array_max("_parts")["text"].alias("_best"), F.when(F.col("_parts").isNotNull(), total).alias("total"))
    d = d.withColumn("short", F.when(F.size("_near") > 0, F.array_join(F.col("_near.text"), "\n\n")).otherwise(F.col("_best")))
    use = (F.col("total") > 1) & (F.octet_length("short") <= F.octet_length("text"))
    kept = F.when(F.col("total") > 1, F.greatest(F.size("_near"), F.lit(1))).otherwise(F.col("total"))
    return d.select("id", F.when(use, F.col("short")).otherwise(F.col("text")).alias("text"), kept.cast("long").alias("kept"), F.col("total").cast("long").alias("total"))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs(id, text) under a key of both: rows of one id and different texts stay apart, equal rows have equal results."""
    return docs.select(F.struct("id", F.md5("text").alias("of")).alias("id"), "text")


def gated(fetched: DataFrame, query: str | None, threshold: float = 0.35, least_words: int = 200, embed: Embed | None = None) -> DataFrame:
    """fetched(url, clean_content, word_count, warnings, ...) shaved to the query, with a warning that tells what was done.

    Short pages stay as they are, as do all without a query; pages that were not found have no words and no warning.
    Without a model whole hashes count: a clash of words is no likeness.
    """
    words = F.col("word_count")
    told = lambda w: F.array_union(F.coalesce("warnings", F.array().cast("array<string>")), F.array(w if isinstance(w, Column) else F.lit(w)))
    bypassed = told(f"semantic_shave: bypassed (word_count < {least_words})")
    if not (query or "").strip():
        return fetched.withColumn("warnings", F.when(words < least_words, bypassed).when(words >= least_words, told("semantic_shave_missing_query")).otherwise(F.col("warnings")))
    cut = shaved(fetched.where(words >= least_words).select(F.col("url").alias("id"), F.col("clean_content").alias("text")).distinct(), query, threshold, embed, dimensions=None)
    both = fetched.join(cut.select(F.col("id").alias("_url"), F.col("text").alias("_text"), "kept", "total"), F.col("_url") == F.col("url"), "left")
    n = lambda c: c.cast("string")
    after = T.word_count(F.col("_text"))
    said = F.concat(F.lit("semantic_shave: kept "), n(F.col("kept")), F.lit("/"), n(F.col("total")), F.lit(" chunks ("), n(words), F.lit(" → "), n(after), F.lit(" words)"))
    hit = F.col("_url").isNotNull()
    warnings = F.when(words < least_words, bypassed).when(hit, told(said)).otherwise(F.col("warnings"))
    new = {"warnings": warnings, "clean_content": F.when(hit, F.col("_text")).otherwise(F.col("clean_content")), "word_count": F.when(hit, after).otherwise(words)}
    return both.select(*[new[c].alias(c) if c in new else F.col(c) for c in fetched.columns])


def section_extract(docs: DataFrame, query: str, limit: int = 5, threshold: float = 0.45, least_words: int = 200, embed: Embed | None = None) -> DataFrame:
    """docs(id, text) cut to the sections near the query, in their order: id, text, note.

    Short texts stay; a section that holds a query word counts as 1; if none
    reaches the threshold the best stays; so does a text that would grow.
    """
    if not query.strip():
        return docs.select("id", "text", F.lit("section_extract_missing_query").alias("note"))
    docs = _keyed(docs)
    long_ = docs.where(T.word_count(F.col("text")) >= least_words)
    words = T.query_tokens(query)
    each = long_.dropDuplicates(["id"]).select("id", F.posexplode(T.sections(F.col("text"))).alias("at", "part"))
    keyword = T.has_any(F.lower("part"), words) if words else F.lit(False)
    each = near(each.withColumnRenamed("part", "text"), query, embed).withColumnRenamed("text", "part")
    each = each.withColumn("sim", F.greatest("sim", keyword.cast("double")))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "at"))
    kept = each.withColumn("rank", rank).where((F.col("rank") == 1) | (F.col("sim") >= threshold) & (F.col("rank") <= limit))
    by = kept.groupBy(F.col("id").alias("_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "\n").alias("short"))
    both = docs.select("id", "text").join(by, F.col("_id").eqNullSafe(F.col("id")), "left")
    use = F.col("short").isNotNull() & (F.octet_length("short") <= F.octet_length("text"))
    return both.select("id.id", F.when(use, F.col("short")).otherwise(F.col("text")).alias("text"), F.when(use, "section_extract").alias("note"))
