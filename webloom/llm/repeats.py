"""Repeated byte strings by common-prefix interval trees of enhanced suffix arrays.

Every window of `size` bytes of a text has an anchor, the place of the smallest
hash among its substrings of `GRAM` bytes (the first, if several are smallest).
It reaches further to the left of the anchor or further to the right; with half
of what it has besides, on that side, the anchor's bytes make its gram.  Equal
windows have equal anchors and grams, so the windows split into blocks: a block
is a run of windows with one anchor and one gram, its context the bytes they
span.  A window can only repeat in a block whose gram repeats, and a gram is two
thirds of a window: phrases that a language repeats by chance are shorter.

1. The grams of all blocks are counted by their hashes.  Blocks of grams that
   repeat are written, with the hashes of their contexts.
2. A context of several occurrences repeats as a whole.
3. If a gram has different contexts, some of one occurrence, the bytes of its
   contexts are read again, of each from the one occurrence that stands for it,
   with the suffixes that begin their windows.  Of the
   suffix array only the parts of `size` common bytes and more matter: those
   are found by the hash of so many bytes, and each is sorted.  A stack scan
   over the common prefixes of neighbours gives the tree of intervals; one of
   `size` bytes or more whose suffixes have different bytes to their left is a
   maximal repeat, and all of its suffixes are the occurrences.  A repeat is
   maximal as far as its contexts reach; longer ones appear as several that
   overlap.

A gram with more than `MOST` different contexts is too large for one suffix
array; its windows are compared by their hashes, each on its own, which removes
the same bytes.

`Repeats.groups` ends where contexts end.  `Repeats.maximal` joins what repeats
whole (2), in the tree (3) and by windows to maximal repeats of any length, with
all occurrences, and gathers none of them in one place.

Contexts are told apart by two hashes of 64 bits, their own and their gram's.
What is broadcast are tables of bits, at most 32 MB each, that tell the grams
that repeat and the occurrences whose bytes are wanted; what they name wrongly
does no harm.

Defined results: texts are UTF-8 bytes, null is empty; matches lie within one
text; rows that repeat are texts each, so they repeat each other; texts shorter
than `size` keep all bytes, texts of any length are read whole; an empty table
gives no rows; columns beside doc_id and text are left out, whatever their
names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, hashing

GRAM = 64
#: Different contexts of a gram in one suffix array, and bytes of contexts sorted together.
MOST, SORTED = 2_000, 2 << 20
KEY, CONTEXT = ["text_hash", "n_bytes"], ["gram", "context"]
_PLACE = 31
_LOW = np.uint64((1 << _PLACE) - 1)


class Blocks:
    """The blocks of some texts: start and end of each context in the joined bytes, its text, anchor, gram and context hash."""

    def __init__(self, texts: list[bytes], size: int):
        self.b = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        begins = ends - [len(t) for t in texts]
        none = np.zeros(0, np.int64)
        self.text = self.start = self.count = self.anchor = none
        self.gram = self.context = np.zeros(0, np.uint64)
        if len(self.b) < size:
            return
        strings = hashing.Substrings(self.b)
        grams = strings.every(GRAM)
        packed = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        w = size - GRAM + 1
        fill = -len(packed) % w
        tiles = np.concatenate([packed, np.full(fill, ~np.uint64(0))]).reshape(-1, w)
        ahead = np.minimum.accumulate(tiles, axis=1).ravel()
        behind = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(packed) - w + 1
        anchor = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & _LOW).astype(np.int64)
        text = np.repeat(np.arange(len(texts)), ends - begins)[:n]
        sound = np.arange(n) + size <= ends[text]
        first = np.flatnonzero(sound)
        if not len(first):
            return
        new = np.ones(len(first), bool)
        half = (size - GRAM) // 2
        ahead_of = first <= anchor[first] - half
        new[1:] = (anchor[first[1:]] != anchor[first[:-1]]) | (text[first[1:]] != text[first[:-1]]) | (ahead_of[1:] != ahead_of[:-1])
        at = np.flatnonzero(new)
        self.start, self.text, self.anchor = first[at], text[first[at]], anchor[first[at]]
        self.count = np.diff(np.append(at, len(first)))
        self.end = self.start + self.count - 1 + size
        to_left = ahead_of[at]
        self.gram = strings.of(self.anchor - half * to_left, self.anchor + GRAM + (size - GRAM - half + 1) * ~to_left)
        self.context = strings.of(self.start, self.end) ^ hashing.mixed((self.anchor - self.start).astype(np.uint64))
        self.place = self.start - begins[self.text]

    def key(self, row_hash: np.ndarray) -> np.ndarray:
        """Of each occurrence: its context and _carrier(); row_hash: of the texts' rows."""
        return (self.context.view(np.int64) ^ row_hash[self.text] ^ self.place << 32).view(np.uint64)


def _carrier():
    """The row and place of an occurrence."""
    return F.col("row_hash").bitwiseXOR(F.shiftleft(F.col("place").cast("long"), 32))


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _parts(batches, column: str = "body"):
    for batch in batches:
        for part in common.sized_batches(batch, column, 1 << 20):
            yield part, [x or b"" for x in part.column(column).to_pylist()]


OCCURRENCE = "text_hash long, row_hash long, n_bytes long, place int, count int, gram long, context long"


def _grams(size: int):
    """How often each gram of a batch is in it."""

    @common.tidy
    def run(batches):
        for _, texts in _parts(batches):
            gram, n = np.unique(Blocks(texts, size).gram, return_counts=True)
            yield pa.RecordBatch.from_arrays([_longs(gram), pa.array(n.astype(np.int64))], names=["gram", "n"])

    return run


def _occurrences(size: int, bits: int, sent):
    """The blocks of the grams that the table tells."""

    @common.tidy
    def run(batches):
        for part, texts in _parts(batches):
            x = Blocks(texts, size)
            keep = np.flatnonzero(common.in_table(sent.value, x.gram, bits))
            if len(keep):
                of = x.text[keep]
                sizes = np.array([len(t) for t in texts], np.int64)[of]
                yield pa.RecordBatch.from_arrays([part.column("text_hash").take(pa.array(of)), part.column("row_hash").take(pa.array(of)), pa.array(sizes), pa.array(x.place[keep].astype(np.int32)), pa.array(x.count[keep].astype(np.int32)), _longs(x.gram[keep]), _longs(x.context[keep])], names=["text_hash", "row_hash", "n_bytes", "place", "count", "gram", "context"])

    return run


def _bodies(size: int, bits: int, sent):
    """Contexts with their bytes, of the occurrences that the table tells; once from each task, if a row is repeated."""

    @common.tidy
    def run(batches):
        table, seen = sent.value, set()
        for part, texts in _parts(batches):
            x = Blocks(texts, size)
            if not len(x.gram):
                continue
            key = x.key(part.column("row_hash").to_numpy())
            some = [i for i in np.flatnonzero(common.in_table(table, key, bits)).tolist() if key[i] not in seen]
            if len(seen) > SENT:
                seen.clear()
            seen.update(key[some].tolist())
            raw = x.b.tobytes()
            bodies = [raw[s:e] for s, e in zip(x.start[some].tolist(), x.end[some].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([_longs(x.gram[some]), _longs(x.context[some]), pa.array(x.count[some].astype(np.int32)), pa.array(bodies, pa.binary())], names=["gram", "context", "count", "body"])

    return run


#: Occurrences a task remembers to have sent.
SENT = 1_000_000


def maximal_repeats(contexts: list[bytes], counts: list[int], size: int) -> list[list]:
    """Groups [length, [(context, place)], parent] of the maximal repeats of `size` bytes or more.

    All occurrences of a group are its own members and those of the groups
    whose parent, or parent's parent, it is; so each suffix is listed once.

    counts: how many suffixes of each context, from its first byte on, take part.
    """
    if not contexts:
        return []
    raw = b"".join(contexts)
    b = np.frombuffer(raw, np.uint8)
    ends = np.cumsum([len(c) for c in contexts])
    begins = ends - [len(c) for c in contexts]
    c = np.array(counts)
    of = np.repeat(np.arange(len(contexts)), c)
    place = np.arange(len(of)) - np.repeat(np.cumsum(c) - c, c)
    at = begins[of] + place
    # before a context's first suffix stands a byte of its own
    left = np.where(place > 0, b[np.maximum(at - 1, 0)].astype(np.int64), 256 + of)
    r = hashing.Substrings(b).of(at, at + size)
    order = np.argsort(r, kind="stable")
    r, left_sorted = r[order], left[order]
    heads = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
    sizes = np.diff(np.append(heads, len(r)))
    diverse = (sizes > 1) & (np.minimum.reduceat(left_sorted, heads) != np.maximum.reduceat(left_sorted, heads))
    groups = []
    for h, n in zip(heads[diverse].tolist(), sizes[diverse].tolist(), strict=True):
        members = order[h : h + n].tolist()
        suffixes = sorted((raw[at[i] : ends[of[i]]], i) for i in members)
        some, base = _intervals(suffixes, size, left, of, place), len(groups)
        groups += [[n, m, parent + base if parent >= 0 else -1] for n, m, parent in some]
    return groups


def occurrences_of(groups: list[list]) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, all occurrences) of each group."""
    every = [list(m) for _, m, _ in groups]
    for g, (_, _, parent) in enumerate(groups):  # a parent comes after its children
        if parent >= 0:
            every[parent] += every[g]
    return [(n, m) for (n, _, _), m in zip(groups, every, strict=True)]


def _common(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if x[low:mid] == y[low:mid]:
            low = mid
        else:
            high = mid
    return low


def _intervals(suffixes: list[tuple[bytes, int]], size: int, left: np.ndarray, of: np.ndarray, place: np.ndarray) -> list:
    """Left-diverse intervals of `size` bytes and more of the tree over sorted suffixes.

    As (length, members, number of the parent): numbers are places in the list;
    a suffix is a member of the deepest such interval only, as it is of all
    above that one too.  The stack holds open intervals (common prefix, left
    byte or None if they differ, suffixes without an interval yet, intervals
    without a parent yet).
    """
    out: list = []
    stack: list[list] = []
    lcp = [_common(x[0], y[0]) for x, y in zip(suffixes, suffixes[1:], strict=False)] + [-1]
    for k, (_, i) in enumerate(suffixes):
        side, own, below = left[i], [i], []
        if stack and stack[-1][0] >= lcp[k]:  # the open interval is the deepest that holds this suffix
            stack[-1][2].append(i)
            own = []
        if stack and stack[-1][1] != side:
            stack[-1][1] = None
        while stack and stack[-1][0] > lcp[k]:
            depth, side, mine, children = stack.pop()
            own, below = own + mine, below + children
            if side is None and depth >= size:
                for c in below:
                    out[c][2] = len(out)
                out.append([depth, [(int(of[j]), int(place[j])) for j in own], -1])
                own, below = [], [len(out) - 1]
            if stack and stack[-1][1] != side:
                stack[-1][1] = None
        if stack and stack[-1][0] == lcp[k]:
            stack[-1][2] += own
            stack[-1][3] += below
        elif lcp[k] >= 0:
            stack.append([lcp[k], side, own, below])
    return out


#: A row for each member; a repeat whose occurrences are all its children's has one row without a member.
REPEAT = "gram long, context long, length int, place int, repeat long, parent long"


def _repeated(size: int):
    """Maximal repeats of contexts that come sorted by gram; many grams are sorted in one suffix array."""

    def flush(rows):
        rows = list({(r[0], r[1]): r for r in rows}.values())
        groups = maximal_repeats([r[2] for r in rows], [r[3] for r in rows], size)
        first: list = [min(((*rows[i][:2], p) for i, p in m), default=None) for _, m, _ in groups]
        for g, (_, _, parent) in enumerate(groups):  # a parent comes after its children
            if parent >= 0:
                first[parent] = min(x for x in (first[parent], first[g]) if x)
        names = [int.from_bytes(hashlib.blake2b(repr((f, g[0])).encode(), digest_size=8).digest(), "big", signed=True) for f, g in zip(first, groups, strict=True)]
        made = []
        for f, name, (length, members, parent) in zip(first, names, groups, strict=True):
            above = names[parent] if parent >= 0 else None
            made += [(rows[i][0], rows[i][1], length, p, name, above) for i, p in members] or [(f[0], None, length, None, name, above)]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate(kinds)], names=["gram", "context", "length", "place", "repeat", "parent"])

    @common.tidy
    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("gram", "context", "body", "count")), strict=True):
                if held > SORTED and r[0] != rows[-1][0]:
                    yield flush(rows)
                    rows, held = [], 0
                rows.append(r)
                held += len(r[2])
        if rows:
            yield flush(rows)

    return run


def _windows(size: int):
    @common.tidy
    def run(batches):
        for part, bodies in _parts(batches):
            counts = np.array(part.column("count").to_pylist())
            ends = np.cumsum([len(x) for x in bodies])
            of = np.repeat(np.arange(len(bodies)), counts)
            place = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
            at = ends[of] - np.array([len(x) for x in bodies])[of] + place
            h = hashing.Substrings(np.frombuffer(b"".join(bodies), np.uint8)).of(at, at + size)
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays([part.column("gram").take(take), part.column("context").take(take), pa.array(place.astype(np.int32)), _longs(h)], names=["gram", "context", "place", "window"])

    return run


class Repeats:
    """Repeats of `size` bytes and more in docs(doc_id, text).

    occurrences: the blocks that may repeat; groups: maximal repeats within
    contexts as a tree, each suffix with its longest one (REPEAT); covers: per context
    the places [low, high) that repeats cover.  All are tables that stay until
    a common.scratch() around ends.
    """

    def __init__(self, docs: DataFrame, size: int = 200):
        self.size, spark = size, docs.sparkSession
        body = F.coalesce("text", F.lit(""))
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body).alias("text_hash"), body.cast("binary").alias("body"))
        hashed = self.docs.select("text_hash", F.xxhash64("doc_id", "text_hash").alias("row_hash"), "body")
        several = self.docs.select("body").mapInArrow(_grams(size), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1")
        several = common.stored(several.select(F.col("gram").alias("key")), "several")
        bits = common.bits_for(several.count())
        sent = spark.sparkContext.broadcast(common.bit_table(several, bits))
        self.occurrences = common.stored(hashed.mapInArrow(_occurrences(size, bits, sent), OCCURRENCE), "occurrences")
        sent.destroy()
        common.spent(several)
        kinds = self.occurrences.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min("count").alias("count"), F.min(_carrier()).alias("carrier"))
        self.contexts = common.stored(kinds, "contexts")
        per = self.contexts.groupBy("gram").agg(F.count("*").alias("contexts"), F.min("n").alias("least")).where((F.col("contexts") > 1) & (F.col("least") == 1))
        per = common.stored(per.select("gram", "contexts"), "grams")
        wanted = common.stored(self.contexts.join(common.near(per), "gram").select(F.col("context").bitwiseXOR(F.col("carrier")).alias("key")), "wanted")
        bits = common.bits_for(wanted.count())
        sent = spark.sparkContext.broadcast(common.bit_table(wanted, bits))
        bodies = hashed.mapInArrow(_bodies(size, bits, sent), "gram long, context long, count int, body binary")
        near = held = common.stored(bodies, "bodies")
        sent.destroy()
        common.spent(wanted)
        hot = common.stored(per.where(F.col("contexts") > MOST).select("gram"), "hot")
        any_hot = bool(hot.limit(1).count())
        if any_hot:
            large = near.join(common.near(hot), "gram", "left_semi")
            near = near.join(common.near(hot), "gram", "left_anti")
        self.groups = common.stored(near.repartition("gram").sortWithinPartitions("gram", "context").mapInArrow(_repeated(size), REPEAT), "repeats")
        own = F.col("context").isNotNull()
        self.windows = None
        covers = self.groups.where(own).select(*CONTEXT, F.col("place").alias("low"), (F.col("place") + F.col("length")).alias("high"))
        if any_hot:
            each = common.stored(large.mapInArrow(_windows(size), "gram long, context long, place int, window long").distinct(), "windows")
            twice = each.groupBy("gram", "window").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("gram", "window")
            self.windows = each.join(twice, ["gram", "window"])
            covers = covers.unionByName(self.windows.select(*CONTEXT, F.col("place").alias("low"), (F.col("place") + size).alias("high")))
        whole = self.contexts.where(F.col("n") > 1).select(*CONTEXT, F.lit(0).alias("low"), (F.col("count") - 1 + size).alias("high"))
        every = covers.unionByName(whole).groupBy(*CONTEXT).agg(F.sort_array(F.collect_set(_span(F.col("low"), F.col("high")))).alias("spans"))
        # as a table of its own, so that a join can split what one context has most of
        self.covers = common.stored(every.select(*CONTEXT, _joined(F.col("spans")).alias("spans")), "covers")
        common.spent(held)

    def spans(self) -> DataFrame:
        """text_hash, n_bytes, spans: the covered places of each text that has any, as low * 2**31 + high; they overlap."""
        at = self.occurrences.select(*KEY, "place", *CONTEXT).join(self.covers, CONTEXT)
        moved = F.transform("spans", lambda s: s + _span(F.col("place"), F.col("place")))
        return at.select(*KEY, F.explode(moved).alias("span")).groupBy(*KEY).agg(F.collect_list("span").alias("spans"))

    def _parts(self) -> DataFrame:
        """What repeats within contexts: gram, repeat, length, context, place; with all its places, those below it in a tree too."""
        name, row = ["gram", "repeat", "length"], ["gram", "repeat", "length", "context", "place"]
        tree = self.groups.select(*name, "parent").distinct()
        above = tree.select("gram", F.col("repeat").alias("parent"), F.col("length").alias("above"))
        up = tree.where(F.col("parent").isNotNull()).join(above, ["gram", "parent"])
        level = self.groups.where(F.col("context").isNotNull()).select(*row)
        parts = level
        while level.limit(1).count():
            level = common.stored(level.join(up, name).select("gram", F.col("parent").alias("repeat"), F.col("above").alias("length"), "context", "place"), "level")
            parts = parts.unionByName(level)
        whole = self.contexts.where(F.col("n") > 1).select("gram", F.col("context").alias("repeat"), (F.col("count") - 1 + self.size).alias("length"), "context", F.lit(0).alias("place"))
        parts = parts.unionByName(whole)
        if self.windows is not None:
            parts = parts.unionByName(self.windows.select("gram", F.col("window").alias("repeat"), F.lit(self.size).alias("length"), "context", "place"))
        return parts

    def maximal(self, reach: int = 1024) -> DataFrame:
        """Maximal repeats with all of their occurrences: repeat, length, n (occurrences), text_hash, n_bytes, place, copies (rows of that text).

        What repeats within contexts is extended, to the left and to the right,
        as far as all of its occurrences agree: that is the common beginning of
        the least and of the largest of the strings that follow them, so none
        are gathered.  Strings of `reach` bytes are compared, then ever longer
        ones of those that agree in all.  What becomes the same is one repeat.
        Not told are repeats of which each part within a context occurs
        elsewhere as well.
        """
        group, at = ["gram", "repeat", "length"], [*KEY, "pos"]
        o = self._parts().join(self.occurrences.select(*CONTEXT, *KEY, F.col("place").alias("block")), CONTEXT)
        o = o.select(*group, *KEY, (F.col("block") + F.col("place")).alias("pos")).groupBy(*group, *at).agg(F.count("*").alias("copies"))
        o = common.stored(o, "places")
        texts = self.docs.select(*[F.col("text_hash"), F.octet_length("body").cast("long").alias("n_bytes"), "body"]).join(o.select(*KEY).distinct(), KEY, "left_semi").dropDuplicates(KEY)
        texts = common.stored(texts, "texts", 250)
        grown = common.stored(o.groupBy(*group).agg(F.sum("copies").alias("n"), F.lit(0).alias("left"), F.lit(0).alias("right"), F.lit(True).alias("open_left"), F.lit(True).alias("open_right")).where("n > 1"), "grown")
        sides = "gram long, repeat long, length int, before binary, after binary"
        while grown.where("open_left or open_right").limit(1).count():
            some = o.join(grown.where("open_left or open_right").select(*group, "left", "right"), group).join(texts, KEY)
            beside = some.select(*group, "pos", "left", "right", "body").mapInArrow(_beside(reach), sides)
            ends = beside.groupBy(*group).agg(*[f(c).alias(f"{n}_{c}") for c in ("before", "after") for n, f in (("least", F.min), ("most", F.max))])
            more = ends.mapInArrow(_agreed, "gram long, repeat long, length int, add_left int, add_right int")
            j = grown.join(more, group, "left")
            add = lambda side: F.when(F.col(f"open_{side}"), F.coalesce(f"add_{side}", F.lit(0))).otherwise(0)
            grown = common.stored(j.select(*group, "n", (F.col("left") + add("left")).alias("left"), (F.col("right") + add("right")).alias("right"), (F.col("open_left") & (add("left") == reach)).alias("open_left"), (F.col("open_right") & (add("right") == reach)).alias("open_right")), "grown")
            reach = min(4 * reach, 1 << 20)
        wide = o.join(grown.select(*group, "n", "left", "right"), group).select(*group, "n", *KEY, (F.col("pos") - F.col("left")).alias("place"), "copies", (F.col("length") + F.col("left") + F.col("right")).alias("bytes"))
        first = wide.groupBy(*group, "n", "bytes").agg(F.min(F.struct(*KEY, "place")).alias("first"))
        # one of those that are the same string
        name = F.xxhash64("first", "bytes").alias("name")
        one = first.groupBy("first", "bytes", name).agg(F.min(F.struct(*group)).alias("g")).select("name", "g.*")
        return common.stored(wide.join(one, group).select(F.col("name").alias("repeat"), F.col("bytes").alias("length"), "n", *KEY, "place", "copies"), "maximal", keep=True)

    def removed(self, texts: bool = True) -> DataFrame:
        """Every row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with texts, kept (the bytes that remain).

        Texts go through the shuffle compressed.
        """
        packed = self.docs.mapInArrow(_packed, "doc_id long, text_hash long, n_bytes long, body binary")
        both = packed.join(self.spans(), KEY, "left").select("doc_id", "body", "spans")
        row = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
        return common.stored(both.mapInArrow(_cut(texts), row + ", kept binary" if texts else row), "removed", 250, keep=True)


def _beside(reach: int):
    """The bytes before (turned round) and after each place of a repeat, as far as it has grown."""

    @common.tidy
    def run(batches):
        for part, bodies in _parts(batches):
            rows = zip(bodies, *(part.column(c).to_pylist() for c in ("pos", "length", "left", "right")), strict=True)
            both = [(b[max(0, p - low - reach) : p - low][::-1], b[p + n + high : p + n + high + reach]) for b, p, n, low, high in rows]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("gram", "repeat", "length")), *(pa.array([x[i] for x in both], pa.binary()) for i in (0, 1))], names=["gram", "repeat", "length", "before", "after"])

    return run


@common.tidy
def _agreed(batches):
    """How far the least and the largest of strings agree, and so all between them."""
    for b in batches:
        add = [[_common(x, y) for x, y in zip(b.column(f"least_{side}").to_pylist(), b.column(f"most_{side}").to_pylist(), strict=True)] for side in ("before", "after")]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("gram", "repeat", "length")), *(pa.array(x, pa.int32()) for x in add)], names=["gram", "repeat", "length", "add_left", "add_right"])


def _span(low, high):
    return F.shiftleft(low.cast("long"), 31) + high


def _joined(spans):
    """Sorted spans of one context as few that do not touch."""
    mask = F.lit((1 << 31) - 1)
    high = lambda s: s.bitwiseAND(mask)

    def add(have, s):
        last = F.try_element_at(have, F.lit(-1))
        wider = F.array(F.shiftleft(F.shiftright(last, 31), 31) + F.greatest(high(last), high(s)))
        return F.when(F.shiftright(s, 31) <= high(last), F.concat(F.slice(have, 1, F.size(have) - 1), wider)).otherwise(F.concat(have, F.array(s)))

    return F.aggregate(spans, F.array().cast("array<bigint>"), add)


@common.tidy
def _packed(batches):
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    for part, bodies in _parts(batches):
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array([len(x) for x in bodies], pa.int64()), pa.array([z.compress(x) for x in bodies], pa.binary())], names=["doc_id", "text_hash", "n_bytes", "body"])


def _merged(spans: np.ndarray) -> list[tuple[int, int]]:
    spans = np.sort(spans)
    low, high = spans >> 31, np.maximum.accumulate(spans & (1 << 31) - 1)
    at = np.flatnonzero(np.append(True, low[1:] > high[:-1])) if len(spans) else np.zeros(0, int)
    return list(zip(low[at].tolist(), high[np.append(at[1:], len(spans)) - 1].tolist(), strict=True)) if len(spans) else []


def _cut(texts: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if texts else 5]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    @common.tidy
    def run(batches):
        import zstandard

        z = zstandard.ZstdDecompressor()
        for part, bodies in _parts(batches):
            rows = []
            for body, spans in zip(map(z.decompress, bodies), part.column("spans"), strict=True):
                runs = _merged(spans.values.to_numpy() if spans.is_valid else np.zeros(0, np.int64))
                kept, at = [], 0
                for low, high in runs:
                    kept.append(body[at:low])
                    at = high
                kept = b"".join([*kept, body[at:]])
                rows.append((len(body), len(body) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept if texts else None))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names) - 1))], names=names)

    return run
