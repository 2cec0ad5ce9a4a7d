"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct n-word shingles, as 64-bit hashes made
of the hashes of its words.
Documents of equal sets form a class; classes x and y link when
|x & y| / |x | y| reaches the threshold.  All classes order shingles alike:
by rarity, estimated in a sketch of fixed size over all documents, then by
hash.  If x and y link, any two prefixes of n - ceil(t n) + m shingles share at
least m.  A class whose estimated candidate cost is high takes a larger m: a
longer prefix, and min(m_x, m_y) common shingles before it is verified.

Copies are not expanded into pairs.  The classes under one prefix shingle are
first compared with one of them, the one with the fewest shingles of its own;
links found so make components.  Only classes that are not in that one's
component are paired further, within the sizes that the positions of their
shared shingles allow; and if both were compared with it, only by shingles that
it lacks, without which they can't link.  Sets are compared whole and exactly.

Texts are read four times: for the sketch, for the prefixes, and twice for the
sets of the classes that have a candidate, told by a table of bits, 32 MB at most.

Defined results: documents with fewer words than a shingle have their whole
sequence as one; null and empty texts have the empty set and link with nothing;
rows that repeat are in one class; a null id is the largest of its component;
texts of any length are compared whole; columns beside doc_id and text are left
out of the result, whatever their names, and kept by one_of_each.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, hashing

#: Cells of the rarity sketch, as a power of two.
SKETCH_BITS = 22
#: Sketch cells that are sent and summed together, as a power of two.
BLOCK_BITS = 16
#: Matches asked of a prefix; the estimated candidates for which they are enough; the most matches.
LEAST, COST, MOST = 4, 64, 8

#: White space becomes a space, A-Z small letters.
_WORDS = bytes(32 if c in b"\x20\x09\x0a\x0b\x0c\x0d" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: its words' hashes, mixed one after the other, so none is a sum of others."""
    split = [t.encode("utf-8", "replace").translate(_WORDS).split() for t in texts]
    counts = [len(w) for w in split]
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, itertools.chain.from_iterable(split)), np.uint64, sum(counts))
    short = {c for c in counts if c < n}
    rows = [h]  # rows[k]: of k + 1 words from each place on
    for k in range(1, n):
        x = rows[-1][:-1] ^ np.uint64(k)
        x ^= x >> np.uint64(29)
        x *= hashing.ODD
        rows.append((x ^ (x >> np.uint64(32))) + h[k:])
    mixed = [hashing.mixed(r) if k == n - 1 or k + 1 in short else r for k, r in enumerate(rows)]
    none = np.zeros(0, np.uint64)
    out, at = [], 0
    for c in counts:
        k = min(n, c)
        out.append(_distinct(mixed[k - 1][at : at + c - k + 1]) if c else none)
        at += c
    return out


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _cells(s: np.ndarray, bits: int) -> np.ndarray:
    return (s >> np.uint64(64 - bits)).astype(np.int64)


def _sketched(n: int):
    """Counts of the shingles of a partition by sketch cell, in packed blocks."""

    @common.tidy
    def run(batches):
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        some = False
        for batch in batches:
            for part in common.sized_batches(batch, "text", 1 << 20):
                sets = shingle_sets(part.column("text").to_pylist(), n)
                total += np.bincount(_cells(np.concatenate(sets), SKETCH_BITS), minlength=len(total)).astype(np.uint32)
                some = True
        if some:
            blocks = [zlib.compress(x.tobytes(), 1) for x in total.reshape(-1, 1 << BLOCK_BITS)]
            yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(blocks)), pa.int32()), "counts": pa.array(blocks, pa.binary())})

    return run


def _added(key, table):
    total = np.zeros(1 << BLOCK_BITS, np.uint64)
    for x in table.column("counts"):
        total += np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
    low = np.minimum(total, (1 << 32) - 1).astype(np.uint32)
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(low.tobytes(), 1)], pa.binary())})


def _table(rows: list, bits: int) -> np.ndarray:
    return np.concatenate([np.frombuffer(zlib.decompress(r["counts"]), np.uint32) for r in sorted(rows, key=lambda r: r["block"])]) if rows else np.zeros(1 << bits, np.uint32)


def _prefixes(n: int, t100: int, sketch):
    names = ["doc_id", "text_hash", "set", "size", "matches", "prefix"]

    @common.tidy
    def run(batches):
        cells = sketch.value
        usual = int(np.median(cells)) + 1
        for batch in batches:
            for part in common.sized_batches(batch, "text", 1 << 20):
                rows = []
                for s in shingle_sets(part.column("text").to_pylist(), n):
                    need = -(-t100 * len(s) // 100)
                    length = len(s) - need + 1 if len(s) else 0
                    if not length:
                        rows.append((_digest(s), 0, 1, b""))
                        continue
                    seen = cells[_cells(s, SKETCH_BITS)]
                    rank = np.log2(1 + seen // usual).astype(np.int64)  # rarity in powers of two; ties by hash
                    order = np.lexsort((s, rank))
                    cost = float(np.maximum(seen[order[:length]].astype(np.int64) - 3 * usual, 0).sum())
                    more = min(MOST, LEAST + int(math.log2(1 + cost / COST)), need)
                    rows.append((_digest(s), len(s), more, s[order[: length + more - 1]].tobytes()))
                kinds = [pa.binary(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=names)

    return run


def _exploded(sent=None, bits: int = 0):
    """Prefixes as rows; with a table, only the shingles that may be in it."""

    @common.tidy
    def run(batches):
        table = None if sent is None else sent.value
        for batch in batches:
            sizes = np.array([x.as_buffer().size // 8 for x in batch.column("prefix")], int)
            for k in range(0, batch.num_rows, 512):
                some, c = batch.slice(k, 512), sizes[k : k + 512]
                flat = np.frombuffer(b"".join(x.as_py() for x in some.column("prefix")), np.int64)
                keep = slice(None) if table is None else common.in_table(table, flat.view(np.uint64), bits)
                at = pa.array(np.repeat(np.arange(len(c)), c)[keep])
                place = (np.arange(len(flat)) - np.repeat(np.cumsum(c) - c, c))[keep]
                yield pa.RecordBatch.from_arrays([pa.array(flat[keep]), some.column("set").take(at), some.column("size").take(at), some.column("matches").take(at), pa.array(place.astype(np.int32))], names=["shingle", "set", "size", "matches", "place"])

    return run


def _wanted(n: int, sent, bits: int):
    @common.tidy
    def run(batches):
        table = sent.value
        for batch in batches:
            for part in common.sized_batches(batch, "text", 1 << 20):
                at, sets, hashes = [], [], []
                for i, s in enumerate(shingle_sets(part.column("text").to_pylist(), n)):
                    d = _digest(s)
                    if common.in_table(table, np.frombuffer(d[:8], ">u8").astype(np.uint64), bits)[0]:
                        at.append(i)
                        sets.append(d)
                        hashes.append(s.tobytes())
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(take), part.column("text_hash").take(take), pa.array(sets, pa.binary()), pa.array(hashes, pa.binary())], names=["doc_id", "text_hash", "set", "hashes"])

    return run


def _compared(t100: int):
    """Pairs with the size of their intersection, whether they link, and a prefix of what only the first has.

    A class that links with the first, if not by what both have in common with
    the second, has at least k of the rest; so prefixes of the rest that leave
    out k - m shingles share m of them.
    """

    @common.tidy
    def run(batches):
        for batch in batches:
            both, linked, rest, matches = [], [], [], []
            for x, y in zip(batch.column("hashes_a"), batch.column("hashes_b"), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common_ = np.isin(a, b, assume_unique=True)
                n = int(common_.sum())
                both.append(n)
                linked.append(100 * n >= t100 * (len(a) + len(b) - n))
                k = max(1, -(-t100 * len(a) // 100) - n)
                m = min(MOST, k)
                only = a[~common_]
                rest.append(only[: max(0, len(only) - k + m)].tobytes())
                matches.append(m)
            kinds = [pa.int32(), pa.bool_(), pa.binary(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *(pa.array(v, t) for v, t in zip((both, linked, rest, matches), kinds, strict=True))], names=["a", "b", "both", "linked", "rest", "matches"])

    return run


def _rests(sent=None, bits: int = 0):
    """What only the first of each pair has, as rows; with a table, only the shingles that may be in it."""

    @common.tidy
    def run(batches):
        table = None if sent is None else sent.value
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                some = batch.slice(k, 512)
                rest = [x.as_py() for x in some.column("rest")]
                flat = np.frombuffer(b"".join(rest), np.int64)
                keep = slice(None) if table is None else common.in_table(table, flat.view(np.uint64), bits)
                at = pa.array(np.repeat(np.arange(len(rest)), [len(x) // 8 for x in rest])[keep])
                yield pa.RecordBatch.from_arrays([pa.array(flat[keep]), *(some.column(c).take(at) for c in ("set", "pivot", "both", "matches", "component", "out"))], names=["shingle", "set", "pivot", "o", "matches", "component", "out"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(set, component) for every set that links (a, b) touch: the smallest set it reaches.

    Labels spread along links and are then followed once more; rounds grow with
    the logarithm of the longest path, not with its length.
    """
    both = common.stored(links.union(links.select("b", "a")).toDF("a", "b").distinct(), "links")
    label = common.stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "set"), "labels")
    while True:
        have = label.select("set", "component")
        near = both.join(have.toDF("b", "other"), "b").groupBy("a").agg(F.min("other").alias("other"))
        step = have.join(near, have["set"] == near["a"]).select("set", F.least("component", "other").alias("new"), "component")
        jump = have.toDF("new", "far")
        new = common.stored(step.join(jump, "new").select("set", F.least("new", "far").alias("component"), (F.least("new", "far") != F.col("component")).alias("moved")), "labels")
        common.spent(label)
        label = new
        if not new.where("moved").limit(1).count():
            common.spent(both)
            return new.select("set", "component")


class Join:
    """Classes, prefixes and links of docs(doc_id, text)."""

    def __init__(self, docs: DataFrame, n: int = 4, threshold: float = 0.85):
        self.spark, self.n, self.t100 = docs.sparkSession, n, round(100 * threshold)
        text = F.coalesce("text", F.lit(""))
        self.docs = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))
        texts = self.docs.select("text")
        blocks = texts.mapInArrow(_sketched(n), "block int, counts binary").groupBy("block").applyInArrow(_added, "block int, counts binary")
        with common.batches_of(self.spark, 2000, 4 << 20):
            sketch = self.spark.sparkContext.broadcast(_table(blocks.collect(), SKETCH_BITS))
        rows = self.docs.mapInArrow(_prefixes(n, self.t100, sketch), self.docs.select("doc_id", "text_hash").schema.add("set", "binary").add("size", "integer").add("matches", "integer").add("prefix", "binary"))
        #: A row for each document and one for each class.
        stored = common.stored(rows, "prefixes", 500)
        sketch.destroy()
        self.members = stored.select("doc_id", "text_hash", "set", "size")
        # of each class, the row that stands for it; copies of that very row stand for it too, which only repeats its pairs
        first = self.members.where(F.col("size") > 0).groupBy(F.col("set").alias("s")).agg(F.min(F.struct("doc_id", "text_hash")).alias("r"))
        self.first = common.near(common.stored(first.select("s", F.col("r.doc_id").alias("d"), F.col("r.text_hash").alias("h")), "first"))
        self.classes = stored.join(self.first, self._stands()).select("set", "size", "matches", "prefix")
        self.links = self._links()

    @staticmethod
    def _stands():
        return (F.col("s") == F.col("set")) & F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash"))

    def _shared(self) -> DataFrame:
        """Prefix shingles that several classes have: (shingle, set, size, matches, place), place from 0 in the prefix.

        Those that only one class has are dropped by a table of bits before the classes are shuffled with them.
        """
        row = "shingle long, set binary, size int, matches int, place int"
        every = self.classes.mapInArrow(_exploded(), row)
        several = common.stored(every.groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("shingle"), "several")
        bits = common.bits_for(several.count())
        sent = self.spark.sparkContext.broadcast(common.bit_table(several.select(F.col("shingle").alias("key")), bits))
        shared = common.stored(self.classes.mapInArrow(_exploded(sent, bits), row).join(several, "shingle"), "shared")
        sent.destroy()
        common.spent(several)
        return shared

    def _compare(self, pairs: DataFrame) -> DataFrame:
        """pairs(a, b) with both, linked and rest, from whole sets; the texts of their classes are read for them."""
        wanted = common.stored(pairs.select(F.col("a").alias("w")).union(pairs.select(F.col("b").alias("w"))).distinct(), "wanted")
        key = F.conv(F.hex(F.substring("w", 1, 8)), 16, -10).cast("long")
        bits = common.bits_for(wanted.count())
        sent = self.spark.sparkContext.broadcast(common.bit_table(wanted.select(key.alias("key")), bits))
        docs = self.docs.select("doc_id", "text_hash", "text")
        found = docs.mapInArrow(_wanted(self.n, sent, bits), docs.select("doc_id", "text_hash").schema.add("set", "binary").add("hashes", "binary"))
        sets = common.stored(found.join(common.near(wanted), F.col("w") == F.col("set"), "left_semi").join(self.first, self._stands()).select("set", "hashes"), "sets", 250)
        sent.destroy()
        second = common.stored(pairs.select(F.col("b").alias("w")).distinct(), "wanted")
        one = sets.toDF("a", "hashes_a").join(common.near(pairs), "a")
        two = sets.join(common.near(second), F.col("w") == F.col("set"), "left_semi").toDF("b", "hashes_b")
        compared = common.stored(one.join(two, "b").select("a", "b", "hashes_a", "hashes_b").mapInArrow(_compared(self.t100), "a binary, b binary, both int, linked boolean, rest binary, matches int"), "compared", 100)
        common.spent(wanted, sets, second)
        common.relieve(self.spark)
        return compared

    def _links(self) -> DataFrame:
        t = self.t100
        least = lambda x, y: F.ceil(t * (x + y) / (100 + t))  # noqa: E731  common shingles that sets of these sizes need
        # A class that shares a shingle has all its shingles before that one in its prefix.  So what another class has
        # of them before it, unshared, is not common to the two; that bounds what is common, and so the partner's size.
        nth = F.row_number().over(Window.partitionBy("set").orderBy("place"))
        table = self._shared()
        shared = table.withColumns({"own": F.col("place") - nth + 1, "n": F.count("*").over(Window.partitionBy("set"))})
        low, high = F.ceil(t * F.col("size") / 100), F.floor((F.col("size") - F.col("own")) * (100 + t) / t - F.col("size"))
        s = shared.withColumns({"low": low, "high": F.least(high, F.floor(100 * F.col("size") / t))})
        enough = F.least(F.lit(LEAST), "matches", F.ceil(t * low / 100))  # partners ask for as many at least
        s = s.where((F.col("low") <= F.col("high")) & (F.col("n") >= enough)).select("shingle", "set", "size", "matches", "low", "high", (F.col("own") / F.col("size")).alias("own"))
        s = bounded = common.stored(s, "bounded")
        common.spent(table)

        # each class with the pivot of its shingles: the class that has the least of its own
        pivot = s.groupBy("shingle").agg(F.min(F.struct("own", "set", "size", "matches", "low", "high")).alias("p"))
        s = common.stored(s.join(pivot, "shingle").select(*s.columns, "p.set", *[F.col(f"p.{c}").alias(c + "_p") for c in ("size", "matches", "low", "high")]).toDF(*s.columns, "pivot", "size_p", "matches_p", "low_p", "high_p"), "pivots")
        common.spent(bounded)
        star = s.where((F.col("set") != F.col("pivot")) & F.col("size_p").between(F.col("low"), F.col("high")) & F.col("size").between(F.col("low_p"), F.col("high_p")))
        near = star.groupBy("set", "pivot").agg(F.count("*").alias("n"), F.first(F.least("matches", "matches_p")).alias("need")).where(F.col("n") >= F.col("need"))
        pairs = common.stored(near.select(F.col("set").alias("a"), F.col("pivot").alias("b")), "star")
        star = self._compare(pairs)
        common.spent(pairs)
        links = star.where("linked").select("a", "b")
        label = components(links)
        near_label, near_star = common.near(label), common.near(common.stored(star.select(F.col("a").alias("set"), F.col("b").alias("pivot"), F.col("both").alias("o")), "star"))

        def labelled(rows: DataFrame) -> DataFrame:
            """rows(set, pivot) with both components; a class without links is its own."""
            r = rows.join(near_label.toDF("set", "component"), "set", "left").join(near_label.toDF("pivot", "pivots"), "pivot", "left")
            return r.withColumns({"component": F.coalesce("component", "set"), "pivots": F.coalesce("pivots", "pivot")})

        # Classes of a shingle that are not in its pivot's component meet the others.  Two that were both compared with
        # the pivot, and have less in common with it than they need of each other, link only by shingles that the pivot
        # lacks: they meet by those, below.
        over = s.join(near_star, ["set", "pivot"], "left")
        over = labelled(over.withColumn("o", F.when(F.col("set") == F.col("pivot"), F.col("size")).otherwise(F.col("o")))).withColumn("out", F.col("component") != F.col("pivots"))
        group = over.groupBy("shingle").agg(F.min("size").alias("s0"), F.max("size").alias("s1"), F.max("out").alias("some"))
        kind = F.when(F.col("o").isNull(), 0).when(F.col("o") >= least(F.col("size"), F.col("s0")), 1).otherwise(2)
        over = over.join(group.where("some"), "shingle").where((F.col("s0") <= F.col("high")) & (F.col("s1") >= F.col("low")))
        over = common.stored(over.select("shingle", "set", "size", "matches", "low", "high", "o", "component", "out", kind.alias("kind")), "open")
        common.spent(s)
        meets = F.when(F.col("kind") == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).when(F.col("kind") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        names = ["set", "size", "matches", "low", "high", "o", "component", "out"]
        x = over.where("out").select("shingle", F.explode(meets).alias("kind"), *[F.col(c).alias(c + "_x") for c in names])
        y = over.select("shingle", "kind", *[F.col(c).alias(c + "_y") for c in names])
        c = F.col
        apart = (c("component_x") != c("component_y")) & ((c("set_x") < c("set_y")) | ~c("out_y") & (c("set_x") != c("set_y")))
        fits = c("size_y").between(c("low_x"), c("high_x")) & c("size_x").between(c("low_y"), c("high_y"))
        by_pivot = F.coalesce(F.least("o_x", "o_y"), F.lit(1 << 30))
        known = c("o_x").isNotNull() & c("o_y").isNotNull() & (by_pivot < least(c("size_x"), c("size_y")))
        met = x.join(y, ["shingle", "kind"]).where(apart & fits & ~known)
        rest = met.groupBy(F.least("set_x", "set_y").alias("a"), F.greatest("set_x", "set_y").alias("b")).agg(F.count("*").alias("n"), F.first(F.least("matches_x", "matches_y")).alias("need")).where("n >= need").select("a", "b")

        sizes = common.near(common.stored(self.members.select("set", "size").distinct(), "sizes"))
        pairs = labelled(star.withColumnsRenamed({"a": "set", "b": "pivot"})).withColumn("out", F.col("component") != F.col("pivots"))
        row = "shingle long, set binary, pivot binary, o int, matches int, component binary, out boolean"
        outer = common.stored(pairs.where("out").mapInArrow(_rests(), row).select(F.col("shingle").alias("key")).distinct(), "outer")
        bits = common.bits_for(outer.count())
        sent = self.spark.sparkContext.broadcast(common.bit_table(outer, bits))
        own = rests = common.stored(pairs.mapInArrow(_rests(sent, bits), row), "rests")
        sent.destroy()
        common.spent(outer)
        several = own.groupBy("pivot", "shingle").agg(F.count("*").alias("n"), F.max("out").alias("some")).where("some and n > 1").select("pivot", "shingle")
        own = common.stored(own.join(several, ["pivot", "shingle"]).join(sizes, "set").select("pivot", "shingle", "set", "size", "o", "matches", "component", "out"), "rests")
        common.spent(rests)
        names = ["set", "size", "o", "matches", "component", "out"]
        x = own.where("out").select("pivot", "shingle", *[F.col(n).alias(n + "_x") for n in names])
        y = own.select("pivot", "shingle", *[F.col(n).alias(n + "_y") for n in names])
        fits = F.least("size_x", "size_y") * 100 >= t * F.greatest("size_x", "size_y")
        both = x.join(y, ["pivot", "shingle"]).where(apart & fits)
        found = both.groupBy("pivot", c("set_x").alias("a"), c("set_y").alias("b")).agg(F.count("*").alias("n"), F.first(F.least("matches_x", "matches_y")).alias("need")).where("n >= need")
        rest = common.stored(rest.union(found.select("a", "b")).distinct(), "rest")
        common.spent(over, own)
        if rest.limit(1).count():
            links = links.unionByName(self._compare(rest).where("linked").select("a", "b"))
        return links

    def components(self) -> DataFrame:
        """Every row of docs: doc_id, text_hash, size, component (null for the empty set)."""
        label = components(self.links)
        m = self.members.join(label, "set", "left")
        return m.select("doc_id", "text_hash", "size", F.when(F.col("size") > 0, F.coalesce("component", "set")).alias("component"))

    def result(self) -> DataFrame:
        """Every row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
        m = common.stored(self.components(), "components", keep=True)
        least = m.where(F.col("component").isNotNull()).groupBy(F.col("component").alias("c")).agg(F.min("doc_id").alias("least"))
        named = m.join(least, F.col("c") == F.col("component"), "left")
        return named.select("doc_id", F.col("size").cast("long").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least")).cast("long").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 4, threshold: float = 0.85) -> DataFrame:
    """docs with one row of each component: that of the smallest id, null last.

    Texts without words are in no component and stay; rows that agree in id and
    text are one document.
    """
    m = common.stored(Join(docs, n, threshold).components(), "components")
    key = lambda h: F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), h)
    first = m.where(F.col("component").isNotNull()).groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("f")).select("f.doc_id", "f.text_hash")
    stay = first.unionByName(m.where(F.col("component").isNull()).select("doc_id", "text_hash")).select(key(F.col("text_hash").cast("string")).alias("k")).distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("row"), key(F.xxhash64(F.coalesce("text", F.lit(""))).cast("string")).alias("k"))
    every = m.select(key(F.col("text_hash").cast("string")).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    if not every.where("n > 1").limit(1).count():  # no row repeats: those that go are told by their keys
        gone = common.stored(every.select("k").join(stay, "k", "left_anti"), "gone", keep=True)
        return keyed.join(common.near(gone), "k", "left_anti").select("row.*")
    nth = F.row_number().over(Window.partitionBy("k").orderBy("k"))
    return keyed.join(common.stored(stay, "stay", keep=True), "k").withColumn("nth", nth).where(F.col("nth") == 1).select("row.*")
