"""Benchmark decontamination as a prefix-filtered set join; DataFrame functions only.

Every benchmark item becomes windows of `size` consecutive words (an item of
fewer words is one window), a window the sequence of its shingles: the pairs of
neighbouring words (a window of one word has that word).  Containment of a
whole window needs each of its shingles, so its necessary prefix is a single
one: the rarest by its count in the documents.

1. The benchmark's shingles are counted in all documents.  A window with a
   shingle that no document has cannot occur.
2. Only the prefixes meet the documents' shingles.  A place that one of them
   is at comes out with the words around it, no more than a window reaches.
3. Those meet the windows by the prefix: the positional bound drops places
   where the window would begin before the text, the length bound those where
   it would end after it, and the rest are compared word by word, which is
   exact containment.

No text and no shingle of a document is shuffled, but for the places of step 2.
What is broadcast are hashes of shingles, at most `block` of them; of more, the
documents are read once for each block.

Defined results: null and empty texts have no words, hit nothing and are hit by
nothing; texts of any length are read whole; rows that repeat are rows each;
items without id hit words but are not named, items that repeat count once;
windows of many items are one window; empty tables leave all documents clean.
Columns of docs and items other than the named ones have any names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: ASCII characters that are in no word, once A-Z are small letters.
SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
KEY = ["doc_id", "text_hash"]
#: Follows the last word of a text, twice; no word holds such a character.
MARK = "\x00"
#: Stands for the end of a text among hashes of shingles.
END = 0
#: Hashes of shingles in one broadcast: about 100 MB.
BLOCK = 4_000_000


def words(text: Column) -> Column:
    """Words of a text, A-Z as small letters: one translation makes all separators spaces."""
    line = F.trim(F.translate(F.coalesce(text, F.lit("")), common.UPPER + SEPARATORS, common.UPPER.lower() + " " * len(SEPARATORS)))
    return F.array_remove(F.split(line, " +"), "")  # of no words, an empty one


def windows(items: DataFrame, size: int = 10) -> DataFrame:
    """words of each distinct window, and the items it is of."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    each = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words"))
    return each.groupBy("words").agg(F.collect_set("item_id").alias("items"))


def text_key(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, w (its words): rows that agree in the first two are copies of one row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), words(text).alias("w"))


def _shingled(rows: DataFrame, *kept: str) -> DataFrame:
    """rows(w, ...): kept, pos and key of each shingle, then END at the place after the last word.

    No lambda functions: from words to keys, and to what they join, all is one
    stage of generated code, in which w is not copied for each shingle.
    """
    more = rows.select(*kept, "w", F.concat("w", F.array(F.lit(MARK), F.lit(MARK))).alias("_more"))
    n = F.size("w") + 1
    pairs = more.select(*kept, "w", F.posexplode(F.arrays_zip(F.slice("_more", 1, n).alias("a"), F.slice("_more", 2, n).alias("b"))).alias("pos", "_pair"))
    key = F.when(F.col("_pair.a") == MARK, F.lit(END).cast("long")).when(F.col("_pair.b") == MARK, F.lit(None).cast("long")).otherwise(F.xxhash64("_pair.a", "_pair.b"))
    return pairs.select(*kept, "w", "pos", key.alias("key"))


def _single(rows: DataFrame, *kept: str) -> DataFrame:
    """As _shingled, with the words as shingles."""
    return rows.select(*kept, "w", F.posexplode("w").alias("pos", "_word")).select(*kept, "w", "pos", F.xxhash64("_word").alias("key"))


def _blocks(keys: DataFrame, block: int) -> list[DataFrame]:
    """keys(key), stored, in parts that a join may broadcast."""
    n = max(1, math.ceil(keys.count() / block))
    return [F.broadcast(keys if n == 1 else keys.where(F.pmod(F.col("key"), F.lit(n)) == i)) for i in range(n)]


def _counted(docs: DataFrame, keys: DataFrame, shingled, block: int) -> DataFrame:
    """key, n: how often each of keys(key) is in docs(w)."""
    parts = [shingled(docs.select("w")).select("key").join(part, "key").groupBy("key").agg(F.count("*").alias("n")) for part in _blocks(keys, block)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _prefixes(docs: DataFrame, win: DataFrame, shingled, block: int) -> DataFrame:
    """win with key and offset of the rarest shingle, for the windows of which each shingle is in docs."""
    at = shingled(win.withColumn("w", F.col("words")), "words").where(F.col("key") != END).select("words", F.col("pos").alias("offset"), "key")
    at = common.stored(at, "shingles")
    n = common.stored(_counted(docs, common.stored(at.select("key").distinct(), "keys"), shingled, block), "counts")
    rank = at.join(common.near(n), "key", "left").groupBy("words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "offset")).alias("p"))
    return rank.where(F.col("p.n") > 0).join(win, "words").select("words", "items", "p.key", "p.offset")


def _met(docs: DataFrame, prefix: DataFrame, shingled, size: int, block: int, marks: bool) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_hash, n (pos of END) of every document, if marks; places where prefixes stand, with the words around."""
    keys = prefix.select("key").distinct()
    if marks:
        keys = keys.unionByName(docs.sparkSession.range(END, END + 1).toDF("key"))
    reach = max(size - 1, 1)
    left = F.least(F.col("pos"), F.lit(reach - 1))
    around = F.when(F.col("key") != END, F.slice("w", F.col("pos") - left + 1, left + 1 + reach))
    found = None
    for part in _blocks(common.stored(keys, "prefixes"), block):
        one = shingled(docs, *KEY).join(part, "key").select(*KEY, "pos", "key", left.alias("left"), around.alias("near"))
        found = one if found is None else found.unionByName(one)
    found = common.stored(found, "places")
    return found.where(F.col("key") == END).select(*KEY, F.col("pos").alias("n")), found.where(F.col("key") != END)


def _found(docs: DataFrame, items: DataFrame, size: int, block: int, marks: bool) -> tuple[DataFrame | None, DataFrame]:
    """The number of words of every document, if marks; the occurrences as of hits()."""
    d = text_key(docs)
    win = common.stored(windows(items, size), "windows")
    ends, hits = None, None
    for shingled, some in ((_shingled, win.where(F.size("words") > 1)), (_single, win.where(F.size("words") == 1))):
        if shingled is _single and not some.limit(1).count():
            continue
        prefix = common.stored(_prefixes(d, some, shingled, block), "prefix")
        end, places = _met(d, prefix, shingled, size, block, marks and shingled is _shingled)
        ends = ends if ends is not None else end
        first, n = F.col("left") - F.col("offset"), F.size("words")
        met = places.join(common.near(prefix), "key").where((first >= 0) & (first + n <= F.size("near")))
        same = met.where(F.slice("near", first + 1, n) == F.col("words"))
        one = same.select(*KEY, (F.col("pos") - F.col("offset")).alias("start"), n.alias("n_words"), F.concat_ws(" ", "words").alias("window"), "items")
        hits = one if hits is None else hits.unionByName(one)
    return ends, hits


def hits(docs: DataFrame, items: DataFrame, size: int = 10, block: int = BLOCK) -> DataFrame:
    """doc_id, text_hash, start (of a word, from 0), n_words, window, items: each occurrence of a window in a document."""
    return _found(docs, items, size, block, False)[1]


def summary(found: DataFrame) -> DataFrame:
    """Per document of hits(): n_hit (words inside windows) and item_ids, as text."""
    inside = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n_words"] - 1)))
    ids = F.flatten(F.collect_set(F.transform("items", lambda i: i.cast("string"))))
    by = found.groupBy(*KEY).agg(F.collect_set(F.struct("start", "n_words")).alias("spans"), F.array_distinct(ids).alias("item_ids"))
    return by.select(*KEY, F.size(F.array_distinct(inside)).cast("long").alias("n_hit"), "item_ids")


def report(docs: DataFrame, items: DataFrame, size: int = 10, block: int = BLOCK) -> DataFrame:
    """Every document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    ends, found = _found(docs, items, size, block, True)
    s = summary(found).withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
    both = ends.join(s, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash")), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    named = F.concat_ws(",", F.sort_array(ids))
    return both.select("doc_id", F.col("n").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """docs without the documents in which a window of an item occurs."""
    bad = common.near(common.stored(hits(docs, items, size).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).distinct(), "hit", keep=True))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    return rows.join(bad, F.col("d").eqNullSafe(F.col("k")) & (F.col("h") == F.col("key")), "left_anti").select("row.*")
