"""Schema-driven extraction with a confidence that counts what is there, grounded and of its type."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..functions import fields as X
from ..functions import quality as Q
from . import store

#: Bytes of values with their words that every task may have.
NEAR = 32 << 20


def extracted(pages: DataFrame, schema: list[X.Field], strict: bool = True, sparse_words: int = 10, empty_share: float = 0.9) -> DataFrame:
    """pages (scored rows of sources.pages) with `data` (field name to values), `confidence` and `warnings`.

    Wholly column expressions over each row: one pass, no shuffle.
    """
    page = {"url": F.col("url"), "title": F.col("title"), "description": F.col("meta_description"), "content": F.col("clean_content"), "headings": F.col("headings"), "page_type": F.col("page_type")}
    source = F.lower(F.concat_ws("\n", "clean_content", "title", "meta_description", "author", "published_at"))
    none = F.array().cast("array<string>")
    p = pages.withColumn("_source", source)
    for i, f in enumerate(schema):
        v = F.coalesce(X.value_of(f, page), none)
        if strict and not f.wants_array:
            v = F.slice(v, 1, 1)
        p = p.withColumn(f"_v{i}", v)
    have = [F.size(F.col(f"_v{i}")) > 0 for i in range(len(schema))]
    total = lambda conditions: sum((c.cast("int") for c in conditions), F.lit(0))
    n = max(1, len(schema))
    grounded, counted = [], []
    for i, f in enumerate(schema):
        if f.is_exempt:
            grounded.append(have[i])  # counts above the line only
        else:
            grounded.append(have[i] & F.forall(F.col(f"_v{i}"), lambda v: Q.is_grounded(v, F.col("_source"), lowered=True)))
            counted.append(have[i])
    denominator = total(counted)
    ground = F.when(denominator > 0, total(grounded) / denominator).otherwise(1.0)
    typed = [(have[i], have[i] & F.coalesce(X.type_name(F.col(f"_v{i}"), f), F.lit(False))) for i, f in enumerate(schema) if f.kind]
    kinds = F.when(total([a for a, _ in typed]) > 0, total([b for _, b in typed]) / total([a for a, _ in typed])).otherwise(1.0)
    mixed = 0.4 * total(have) / n + 0.4 * ground + 0.2 * kinds
    scalars = [i for i, f in enumerate(schema) if not f.wants_array]
    lines = F.size(F.filter(F.split("clean_content", "\\n"), lambda x: F.trim(x) != ""))
    empty = total([~have[i] for i in scalars]) / max(1, len(scalars))
    placeholder = F.lit(bool(scalars)) & ((F.col("word_count") < sparse_words) | (lines <= 1) & (F.col("word_count") < 2 * sparse_words)) & (empty >= empty_share)
    confidence = F.when(placeholder, 0.0).otherwise(F.least(F.greatest(mixed, F.lit(0.0)), F.lit(1.0)))
    data = F.create_map(*[x for i, f in enumerate(schema) for x in (F.lit(f.name), F.col(f"_v{i}"))])
    return p.select("page_id", "url", "title", data.alias("data"), F.round(confidence, 6).alias("confidence"), F.when(placeholder, F.array_union("warnings", F.array(F.lit("placeholder_page")))).otherwise(F.col("warnings")).alias("warnings"))


def auto(pages: DataFrame) -> DataFrame:
    """What can be told without a schema: title, description, e-mails, prices, dates, contents."""
    c = F.col("clean_content")
    return pages.select("page_id", "url", "title", F.coalesce(F.nullif("meta_description", F.lit("")), F.substring(c, 1, 200)).alias("description"), X.emails(c).alias("emails"), X.prices(c).alias("prices"), X.page_date(c).alias("date"), X.main_topics(F.col("headings")).alias("contents"))


def _met(values: DataFrame, docs: DataFrame) -> DataFrame:
    """values(id, v, w) as id, some: how many texts hold the value, or 70 % of its words; each text is read once, by an automaton of all of them."""
    known = values.collect()  # at most NEAR bytes
    sent = values.sparkSession.sparkContext.broadcast([(r["v"], r["w"]) for r in known])
    schema = StructType([StructField("nth", IntegerType()), StructField("n", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        places: dict[str, list[tuple[int, int]]] = {}
        size = np.array([len(w) for _, w in sent.value])
        for i, (v, w) in enumerate(sent.value):
            for word, times in Counter(w).items():
                places.setdefault(word, []).append((i, times))
            places.setdefault(v, []).append((i, len(w)))  # the whole value counts as all of its words
        automaton = ahocorasick.Automaton()
        for nth, word in enumerate(places):
            automaton.add_word(word, nth)
        automaton.make_automaton()
        whose = [np.array([i for i, _ in x]) for x in places.values()]
        times = [np.array([t for _, t in x], np.float64) for x in places.values()]
        for b in batches:
            total = np.zeros(len(size), np.int64)
            for text in b.column(0):
                hits = list({nth for _, nth in automaton.iter(text.as_py())}) if text.is_valid else []
                if hits:
                    have = np.bincount(np.concatenate([whose[h] for h in hits]), np.concatenate([times[h] for h in hits]), len(size))
                    total += have / size >= 0.70
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["nth", "n"])

    if not known:
        return values.select("id", F.lit(0).cast("long").alias("some"))
    ids = values.sparkSession.createDataFrame([(i, r["id"]) for i, r in enumerate(known)], StructType([schema["nth"], values.schema["id"]]))
    counts = store.spread(docs.select(F.lower("text").alias("text"))).mapInArrow(run, schema).groupBy("nth").agg(F.sum("n").alias("some"))
    return counts.join(F.broadcast(ids), "nth").select("id", "some")


def grounded_counts(values: DataFrame, docs: DataFrame) -> DataFrame:
    """values(id, value) as id, grounded: how many of docs(doc_id, text) each value stands in (quality.is_grounded).

    Up to NEAR bytes of values are looked for in each text at once.  More of
    them are joined by words instead of all pairs.  A word of a value stands in a text
    within one of the text's words, so the distinct words of all texts tell, by
    their parts of the lengths asked for, which value's words are where.  A
    value needs 70 % of its words: one at least of its rarest ones, that are
    more than 30 %, has to be there.  Only such pairs are read.
    """
    split = "[^\\p{IsAlphabetic}\\p{N}]+"
    v = values.select("id", F.lower(F.trim("value")).alias("v"))
    v = store.kept(v.withColumn("w", F.filter(F.split("v", split), lambda x: F.octet_length(x) >= 3)))
    size = v.agg(F.sum(3 * F.octet_length("v") + 24 * F.size("w") + 64)).first()[0] or 0
    always = (F.octet_length("v") < 4) | (F.size("w") == 0)
    some = _met(v.where(~always), docs) if size <= NEAR else _joined(v.where(~always), docs, split)
    every = docs.agg(F.count("*").alias("every"))  # one row
    return v.select("id", always.alias("always")).join(some, "id", "left").join(F.broadcast(every)).select("id", F.when(F.col("always"), F.col("every")).otherwise(F.coalesce("some", F.lit(0))).alias("grounded"))


def _joined(v: DataFrame, docs: DataFrame, split: str) -> DataFrame:
    """_met by a join of words, for values of any size."""
    each = v.select("id", F.size("w").alias("n"), F.explode("w").alias("x")).groupBy("id", "n", "x").agg(F.count("*").alias("m"))
    lengths = sorted(r["l"] for r in each.select(F.length("x").alias("l")).distinct().collect())  # of words: a few dozen at most
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), split))).alias("word")).where("word <> ''")
    parts = lambda n: F.when(F.length("word") >= n, F.transform(F.sequence(F.lit(1), F.length("word") - n + 1), lambda i: F.substr(F.col("word"), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    known = words.groupBy("word").agg(F.count("*").alias("n"))
    pieces = F.array_distinct(F.flatten(F.array(*map(parts, lengths)))) if lengths else F.array().cast("array<string>")
    inside = store.kept(known.select("word", "n", F.explode(pieces).alias("x")).join(each.select("x").distinct(), "x"))
    rarity = inside.groupBy("x").agg(F.sum("n").alias("r"))
    upto = F.sum("m").over(Window.partitionBy("id").orderBy("r", "x"))
    prefix = each.join(rarity, "x", "left").withColumn("r", F.coalesce("r", F.lit(0))).withColumn("before", upto - F.col("m")).where(F.col("before") <= 0.3 * F.col("n"))
    wanted = inside.join(prefix.select("id", "x"), "x").select("word", "id").distinct()
    pairs = words.join(wanted, "word").select(F.col("doc_id").alias("d"), "id").distinct()
    met = pairs.join(docs.select("doc_id", F.lower("text").alias("text")), F.col("d").eqNullSafe(F.col("doc_id"))).join(v.select("id", "v"), "id")
    return met.where(Q.is_grounded(F.col("v"), F.col("text"), lowered=True)).groupBy("id").agg(F.count("*").alias("some"))
