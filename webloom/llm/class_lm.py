"""Class-based n-gram language model (Brown): exchange clustering of words.

The most frequent words are items of their own, all others share bundles by
their last three bytes.  The exchange algorithm moves items between classes as
long as the likelihood of class bigrams grows.  Then every other word of more
than one occurrence in training leaves its bundle for the class that the
likelihood of class bigrams grows most with, by the counts of the classes
beside all of its occurrences.  Bundles remain for words that training has once
or never: how those stand is told best by each other.  An unseen word counts as
one event of its bundle.  A text's probability is
the product of class transitions, and of each word within its class, which
leaves a discounted share to the unseen.  Transitions are counted with the
words' own classes and smoothed by the class frequencies.

Counts come from all training texts: counts, classes and neighbours of words
are distributed tables, joined by word with the rare words of each document.
What is broadcast, the `head` most frequent words, the items and the class
bigrams, has a fixed size.

Defined results: null texts are empty; an empty text is one end token; rows
that repeat are rows each; a null id is neither held out nor learned from; with
nothing to learn from every word is unseen; texts of any length count whole;
columns beside doc_id and text are left out, whatever their names.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: The end of a text among the words, none of which holds white space.
END = b"\n"
#: White space becomes a space, A-Z small letters.
_WORDS = bytes(32 if c in b"\x20\x09\x0a\x0b\x0c\x0d" else c + 32 if 65 <= c <= 90 else c for c in range(256))


#: Tokens that the class frequencies count for among the transitions from a class.
STRENGTH = 5.0


def tokenized(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of texts, the END among them, the word of each token, and where each text's tokens end."""
    raw = b"".join(t.translate(_WORDS) + b" \n " for t in texts.cast(pa.binary()).to_pylist())
    every = pc.split_pattern(pa.array([raw], pa.binary()), b" ").values
    tokens = every.filter(pc.greater(pc.binary_length(every), 0)).dictionary_encode()
    words, at = tokens.dictionary, tokens.indices.to_numpy()
    end = pc.index(words, pa.scalar(END, pa.binary())).as_py() if len(words) else 0
    return words, at, np.flatnonzero(at == end) + 1


def _codes(words: pa.Array, of) -> np.ndarray:
    return np.fromiter(map(of, words.to_pylist()), np.int64, len(words))


def bundle_of(word: bytes, bundles: int) -> int:
    return zlib.crc32(word[-3:]) % bundles


def _counted(limit: int):
    """Counts of a partition's tokens, in parts of about `limit` words."""

    def merged(parts: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
        words = pa.concat_arrays([w for w, _ in parts]).dictionary_encode()
        return words.dictionary, np.bincount(words.indices.to_numpy(), np.concatenate([n for _, n in parts]), len(words.dictionary)).astype(np.int64)

    @common.tidy
    def run(batches):
        parts: list[tuple[pa.Array, np.ndarray]] = []
        for batch in batches:
            for some in common.sized_batches(batch, "text", 2 << 20):
                words, at, _ = tokenized(some.column("text"))
                parts.append((words, np.bincount(at, minlength=len(words))))
                if sum(len(w) for w, _ in parts) > 2 * limit:
                    parts = [merged(parts)]
                    if len(parts[0][0]) > limit:
                        yield pa.RecordBatch.from_arrays([parts[0][0], pa.array(parts[0][1])], names=["word", "n"])
                        parts = []
        if parts:
            words, n = merged(parts)
            yield pa.RecordBatch.from_arrays([words, pa.array(n)], names=["word", "n"])

    return run


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def _gains(table: np.ndarray, after: np.ndarray, before: np.ndarray, own: float) -> np.ndarray:
    """What the likelihood gains if a word that the table leaves out joins each class; own: how often it follows itself."""
    r, s, d = np.flatnonzero(after), np.flatnonzero(before), np.diag(table)
    gain = (_f(table[:, r] + after[r]) - _f(table[:, r])).sum(1) + (_f(table[s] + before[s][:, None]) - _f(table[s])).sum(0)
    gain += _f(d + after + before + own) - _f(d) - (_f(d + after) - _f(d)) - (_f(d + before) - _f(d))
    rows, columns = table.sum(1) + before, table.sum(0) + after  # tokens of a class stand beside this word too
    return gain - (_f(rows + after.sum() + own) - _f(rows) + _f(columns + before.sum() + own) - _f(columns))


def best_classes(table: np.ndarray, after: np.ndarray, before: np.ndarray, own: np.ndarray, classes: int) -> np.ndarray:
    """The class of the first `classes` that each word is best put into, the first of several.

    table: class bigrams, the words in their bundles; after, before: a row for each
    word, how often it stands before and after each class, without itself; own:
    how often it follows itself.
    """
    k, n_right, n_left = len(table), after.sum(1), before.sum(1)
    gain = np.zeros(after.shape)
    for side, t in ((after, table.T), (before, table)):  # t[c]: the cells that a neighbour of class c counts in
        one = _f(t + 1) - _f(t)
        for c in range(k):
            at = np.flatnonzero(side[:, c])
            n = side[at, c]
            add = one[np.full(len(at), c)]
            more = np.flatnonzero(n > 1)
            add[more] = _f(t[c] + n[more, None]) - _f(t[c])
            gain[at] += add
    # a class that the word stands beside on both sides, or that it brings itself into, has one cell for all of them
    i, c = np.nonzero((after > 0) & (before > 0) | (own > 0)[:, None])
    d, x, y = table[c, c], after[i, c], before[i, c]
    gain[i, c] += _f(d + x + y + own[i]) + _f(d) - _f(d + x) - _f(d + y)
    rows, columns = table.sum(1) + before, table.sum(0) + after  # tokens of a class stand beside the word too
    gain -= _f(rows + (n_right + own)[:, None]) - _f(rows) + _f(columns + (n_left + own)[:, None]) - _f(columns)
    return gain[:, :classes].argmax(1)


def exchange(n_items: int, fixed: int, pairs: np.ndarray, counts: np.ndarray, classes: int, sweeps: int = 8) -> np.ndarray:
    """Classes of items 0 .. n_items - 1 by the exchange algorithm; the item `fixed` is alone in the last class.

    pairs are codes first * n_items + second, counts how often each occurs.
    """
    # the last class holds what is not placed yet; the first items have a class each, the others join the best one
    k = classes + 2
    of = np.full(n_items, classes + 1)
    of[fixed] = classes
    seeds = [i for i in range(n_items) if i != fixed][:classes]
    of[seeds] = np.arange(len(seeds))
    first, second = pairs // n_items, pairs % n_items
    by_first, by_second = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    at_first = np.searchsorted(first[by_first], np.arange(n_items + 1))
    at_second = np.searchsorted(second[by_second], np.arange(n_items + 1))
    counts = counts.astype(float)
    table = np.bincount(of[first] * k + of[second], counts, k * k).reshape(k, k)
    for _ in range(sweeps):
        moved = 0
        for w in range(n_items):
            right, left = by_first[at_first[w] : at_first[w + 1]], by_second[at_second[w] : at_second[w + 1]]
            if w == fixed:
                continue
            own = counts[right][second[right] == w].sum()
            r, s = second[right] != w, first[left] != w
            after = np.bincount(of[second[right][r]], counts[right][r], k)
            before = np.bincount(of[first[left][s]], counts[left][s], k)
            a = of[w]
            table[a] -= after
            table[:, a] -= before
            table[a, a] -= own
            gain = _gains(table, after, before, own)
            c = int(gain[:classes].argmax())
            if a < classes and gain[c] <= gain[a] + 1e-9:
                c = a
            moved += c != a
            of[w] = c
            table[c] += after
            table[:, c] += before
            table[c, c] += own
        if not moved:
            break
    return of


class Model:
    """Everything of bounded size: head words, items, classes, transitions, bundles."""

    def __init__(self, head: pa.Table, total: int, distinct: int, items: int, bundles: int):
        words, n = head["word"].to_pylist(), head["n"].to_numpy().astype(float)
        order = sorted(range(len(words)), key=lambda i: (words[i] != END, -n[i], words[i]))
        self.words, self.count = [words[i] for i in order], n[order]  # the end comes first
        if not self.words:
            self.words, self.count = [END], np.zeros(1)
        self.total, self.distinct, self.bundles = total, distinct, bundles
        self.items = min(items, len(self.words))
        self.item = np.array([i if i < self.items else self.items + bundle_of(w, bundles) for i, w in enumerate(self.words)])

    def items_of(self) -> dict[bytes, int]:
        base, bundles = self.items, self.bundles

        class Items(dict):
            def __missing__(self, word):
                return base + bundle_of(word, bundles)

        return Items(zip(self.words[: self.items], range(self.items), strict=True))

    def finish(self, pairs: np.ndarray, counts: np.ndarray, tails: np.ndarray, types: np.ndarray, discount: float, classes: int) -> None:
        """tails and types: tokens and distinct words of each bundle."""
        n_items = self.items + self.bundles
        of = exchange(n_items, 0, pairs, counts, classes)
        k = classes + 1
        seen = np.bincount(pairs % n_items, counts, n_items) + 0.5
        total = np.bincount(of, seen, k)
        table = np.bincount(of[pairs // n_items] * k + of[pairs % n_items], counts, k * k).reshape(k, k)
        table = (table + STRENGTH * (total / total.sum())) / (table.sum(1, keepdims=True) + STRENGTH)
        self.of, self.step = of, np.log10(table)
        self.emit = np.log10(seen / total[of])
        self.discount = discount
        have = tails > 0
        self.in_bundle = np.log10(np.where(have, tails, 1.0))
        self.unseen = np.where(have, np.log10(np.maximum(discount * types, 1e-300)), 0.0)
        self.log_count = np.log10(self.count + 1)
        rare = np.arange(len(self.words)) >= self.items
        self.within = np.where(rare, np.log10(np.maximum(self.count - discount, 1e-300)) - self.in_bundle[np.maximum(self.item - self.items, 0)], 0.0)

    def place(self, words: pa.Table, per: list[tuple[int, int, int]]) -> None:
        """Classes and emissions of the head words.

        words: class and n of the head words that are no items; per: class,
        tokens and distinct words of all placed words.  A word of count n has
        (n - off) / mass of its class, the unseen words' share is dealt among
        the class's bundles, one event each.
        """
        at, k = {w: i for i, w in enumerate(self.words)}, self.of[0] + 1
        self.classed = np.zeros(len(self.words), np.int64)
        self.classed[: self.items] = self.of[: self.items]
        for w, c in zip(words["word"].to_pylist(), words["class"].to_pylist(), strict=True):
            self.classed[at[w]] = c
        mass = np.bincount(self.of[: self.items], self.count[: self.items], k)
        types = np.bincount(self.of[: self.items], self.count[: self.items] > 0, k)
        for c, n, t in per:
            mass[c] += n
            types[c] += t
        bundles = np.bincount(self.of[self.items :], minlength=k)
        self.off = np.where(bundles > 0, self.discount, 0.0)
        self.mass = np.maximum(mass, 1.0)
        unseen = np.where(types > 0, self.off * types / self.mass, 1.0) / np.maximum(bundles, 1)
        self.unplaced = np.log10(unseen[self.of[self.items :]])
        self.emits = np.log10(np.where(self.count > 0, (self.count - self.off[self.classed]) / self.mass[self.classed], 1.0))


def _paired(sent):
    """Counts of the bigrams of items and bundles."""

    @common.tidy
    def run(batches):
        model = sent.value
        items = model.items_of()
        n = model.items + model.bundles
        total = np.zeros(n * n, np.int32)  # of one task's tokens
        for batch in batches:
            for some in common.sized_batches(batch, "text", 2 << 20):
                words, at, _ = tokenized(some.column("text"))
                x = np.append(0, _codes(words, items.__getitem__)[at])  # the end stands before the first text as well
                total += np.bincount(x[:-1] * n + x[1:], minlength=n * n).astype(np.int32)
        codes = np.flatnonzero(total)
        for low in range(0, len(codes), 100_000):
            part = codes[low : low + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part].astype(np.int64))], names=["pair", "n"])

    return run


#: Words a task counts the neighbours of before it sends them on; words placed together.
HELD, PLACED = 250_000, 4096


def _binaries(x: np.ndarray, ends: np.ndarray) -> pa.Array:
    """x cut at ends, as one binary each."""
    offsets = np.append(0, ends * x.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))])


def _flat(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The values of all binaries of a column, and how many each holds."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data if data is not None else b"", np.uint8)[offsets[0] : offsets[-1]].copy().view(kind), np.diff(offsets) // np.dtype(kind).itemsize


def _neighbours(sent, k: int):
    """Of each word that is no item: how often each class stands before (code c) and after it (k + c), and itself after it (2 k)."""

    @common.tidy
    def run(batches):
        model = sent.value
        items, of, end = model.items_of(), model.of, model.items
        ids: dict[bytes, int] = {}
        held: list[np.ndarray] = []  # codes of a word and of what stands beside it, above the 32 bits of their counts

        def merged() -> np.ndarray:
            x = np.concatenate(held)
            held.clear()
            x.sort()
            heads = np.flatnonzero(np.append(True, x[1:] >> 32 != x[:-1] >> 32))
            return (x[heads] >> 32 << 32) | np.add.reduceat(x & 0xFFFFFFFF, heads)

        def packed():
            x = merged()
            word, code = np.divmod(x >> 32, 2 * k + 1)
            ends = np.cumsum(np.bincount(word, minlength=len(ids)))
            return pa.RecordBatch.from_arrays([pa.array(list(ids), pa.binary()), _binaries(code.astype(np.uint8), ends), _binaries((x & 0xFFFFFFFF).astype(np.int32), ends)], names=["word", "codes", "counts"])

        for batch in batches:
            for some in common.sized_batches(batch, "text", 2 << 20):
                words, which, _ = tokenized(some.column("text"))
                item = _codes(words, items.__getitem__)
                far = np.flatnonzero(item >= end)
                own = np.full(len(words), -1)
                own[far] = [ids.setdefault(w, len(ids)) for w in words.take(pa.array(far)).to_pylist()]
                line, word = np.append(0, item[which]), np.append(-1, own[which])
                at = np.flatnonzero(word >= 0)  # never the last, which is an end
                if not len(at):
                    continue
                w, before, after = word[at], word[at - 1], word[at + 1]
                base = w * (2 * k + 1)
                codes = np.concatenate([(base + of[line[at - 1]])[before != w], (base + k + of[line[at + 1]])[after != w], (base + 2 * k)[after == w]])
                held.append(codes << 32 | 1)
                if sum(map(len, held[1:])) > max(1 << 20, len(held[0])):
                    held.append(merged())
                if len(ids) > HELD:
                    yield packed()
                    ids = {}
        if held:
            yield packed()

    return run


def _placed(table: np.ndarray, classes: int, homes: np.ndarray):
    """Count and class of words that come sorted, with the counts of their neighbours; a word seen once stays with its bundle, in a class of homes."""
    k = classes + 1

    def place(rows: pa.Table):
        words = rows.column("word").combine_chunks()
        new = np.ones(len(words), bool)
        new[1:] = pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)
        code, sizes = _flat(rows.column("codes"), np.uint8)
        count, _ = _flat(rows.column("counts"), np.int32)
        word = np.repeat(np.cumsum(new) - 1, sizes)
        n_words = int(new.sum())
        total = np.bincount(word, count, n_words)
        found, n = np.empty(n_words, np.int64), np.ones(n_words, np.int64)
        # of one occurrence there are two codes, the class before it and the one after it
        lone = (total == 2) & (np.bincount(word, code == 2 * k, n_words) == 0)
        names = words.filter(pa.array(new))
        once = _codes(names.filter(pa.array(lone)), lambda w: bundle_of(w, len(homes)))
        found[lone] = homes[once]
        some = np.flatnonzero(~lone)
        rest = np.flatnonzero(~lone[word])
        word, code, count = np.searchsorted(some, word[rest]), code[rest], count[rest]
        for low in range(0, len(some), PLACED):
            high = min(low + PLACED, len(some))
            a, b = np.searchsorted(word, [low, high])
            dense = np.bincount((word[a:b] - low) * (2 * k + 1) + code[a:b], count[a:b], (high - low) * (2 * k + 1)).reshape(-1, 2 * k + 1)
            before, after, own = dense[:, :k], dense[:, k : 2 * k], dense[:, 2 * k]
            found[some[low:high]] = best_classes(table, after, before, own, classes)
            n[some[low:high]] = before.sum(1) + own
        return pa.RecordBatch.from_arrays([names, pa.array(n), pa.array(found.astype(np.int32))], names=["word", "n", "class"])

    @common.tidy
    def run(batches):
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            words, cut = rows.column("word"), rows.num_rows
            last = words[cut - 1] if cut else None
            while cut and words[cut - 1] == last:  # the last word may go on
                cut -= 1
            rest = rows.slice(cut)
            if cut:
                yield place(rows.slice(0, cut).combine_chunks())
        if rest is not None and rest.num_rows:
            yield place(rest.combine_chunks())

    return run


LOCAL = "doc_id long, learn boolean, rid long, n_tokens long, n_known long, base double, score double, line binary, words array<binary>, places array<binary>, bundles array<int>"
_NONE = 65535


def _local(sent):
    """What the head words tell of each text; the classes of its tokens, _NONE where the word is not of the head, and those words with their places."""

    @common.tidy
    def run(batches):
        from pyspark import TaskContext

        m = sent.value
        place = {w: i for i, w in enumerate(m.words)}
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for some in common.sized_batches(batch, "text", 2 << 20):
                words, at, ends = tokenized(some.column("text"))
                if not len(ends):
                    continue
                starts = np.append(0, ends[:-1])
                head = np.fromiter(map(place.get, words.to_pylist(), itertools.repeat(-1)), np.int64, len(words))
                known, safe = head >= 0, np.maximum(head, 0)
                sums = [np.add.reduceat(x[at], starts) for x in (known & (m.count[safe] > 0), np.where(known, m.log_count[safe], 0.0), np.where(known, m.emits[safe], 0.0))]
                line = np.where(known, m.classed[safe], _NONE).astype(np.uint16)[at]
                # the other words of each text, once each, with all their places in it
                far = np.flatnonzero(head[at] < 0)
                doc = np.searchsorted(ends, far, side="right")
                order = np.lexsort((far, at[far], doc))
                far, doc = far[order], doc[order]
                word = at[far]
                new = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (doc[1:] != doc[:-1]))) if len(far) else np.zeros(0, int)
                names = words.take(pa.array(word[new]))
                offsets = pa.array(np.append(0, np.cumsum(np.bincount(doc[new], minlength=len(ends)))).astype(np.int32))
                lists = [names, _binaries((far - starts[doc]).astype(np.int32), np.append(new[1:], len(far)) if len(far) else new), pa.array(_codes(names, lambda w: bundle_of(w, m.bundles)).astype(np.int32))]
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("learn"), pa.array(np.arange(rid, rid + n)), pa.array(ends - starts), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), _binaries(line, ends), *(pa.ListArray.from_arrays(offsets, x) for x in lists)],
                    names=["doc_id", "learn", "rid", "n_tokens", "n_known", "base", "score", "line", "words", "places", "bundles"],
                )
                rid += n

    return run


@common.tidy
def _filled(batches):
    """Lines with the classes of the words that are not of the head."""
    for batch in batches:
        line, sizes = _flat(batch.column("line"), np.uint16)
        ends = np.cumsum(sizes)
        far = batch.column("far")
        at, each = far.offsets.to_numpy(), far.flatten()
        if len(each):
            place, n = _flat(each.field("places"), np.int32)
            begin = np.repeat(ends - sizes, np.diff(at) if not far.null_count else np.where(far.is_valid().to_numpy(zero_copy_only=False), np.diff(at), 0))
            line[np.repeat(begin, n) + place] = np.repeat(each.field("class").to_numpy().astype(np.uint16), n)
        columns = {n: batch.column(n) for n in batch.schema.names if n not in ("line", "far")}
        yield pa.RecordBatch.from_pydict(columns | {"line": _binaries(line, ends)})


def _stepped_from(column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class before each token of lines, its own, and where the lines begin: after an end."""
    line, sizes = _flat(column, np.uint16)
    x = line.astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    before = np.append(end, x[:-1])[: len(x)]
    before[starts] = end
    return before, x, starts


def _followed(end: int):
    """Counts of the class bigrams of lines."""

    @common.tidy
    def run(batches):
        k = end + 1
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            if batch.num_rows:
                before, x, _ = _stepped_from(batch.column("line"), end)
                total += np.bincount(before * k + x, minlength=k * k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    return run


def _stepped(step: np.ndarray):
    @common.tidy
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            before, x, starts = _stepped_from(batch.column("line"), len(step) - 1)
            columns = {n: batch.column(n) for n in batch.schema.names if n != "line"}
            yield pa.RecordBatch.from_pydict(columns | {"steps": pa.array(np.add.reduceat(step[before, x], starts))})

    return run


def _totals(pairs: DataFrame, size: int) -> np.ndarray:
    got = pairs.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    return np.bincount(got["pair"].to_numpy(), got["n"].to_numpy().astype(float), size)


def score(docs: DataFrame, learn: Column, head: int = 1 << 18, items: int = 2048, bundles: int = 256, classes: int = 64) -> DataFrame:
    """Every row of docs(doc_id, text): doc_id, n_tokens, n_known, train_tokens, base_score, score; learnt from the rows that `learn` picks."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    training = d.where("learn").select("text")
    counts = common.stored(training.mapInArrow(_counted(300_000), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    total, distinct, once, twice = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    # the smallest count whose words, with those of larger counts, are at most `head`
    upto = F.sum("words").over(Window.orderBy(F.desc("n")))
    least = counts.groupBy("n").agg(F.count("*").alias("words")).withColumn("upto", upto).where(F.col("upto") <= head).agg(F.min("n")).first()[0]
    least = F.lit(least if least is not None else 1 << 62)
    model = Model(counts.where((F.col("n") >= least) | (F.col("word") == F.lit(END))).toArrow(), total, distinct, items, bundles)
    sent = spark.sparkContext.broadcast(model)
    with common.batches_of(spark, 2000):
        pairs = training.mapInArrow(_paired(sent), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    sent.destroy()
    discount = min(0.9, max(0.1, once / (once + 2 * twice) if once else 0.5))
    codes = pairs["pair"].to_numpy()
    order = np.argsort(codes, kind="stable")  # the order in which sums arrive changes nothing
    codes, n = codes[order], pairs["n"].to_numpy()[order]
    model.finish(codes, n, np.zeros(bundles), np.zeros(bundles), discount, classes)
    k, n_items = classes + 1, model.items + bundles
    table = np.bincount(model.of[codes // n_items] * k + model.of[codes % n_items], n, k * k).reshape(k, k).astype(float)
    sent = spark.sparkContext.broadcast(model)
    beside = training.mapInArrow(_neighbours(sent, k), "word binary, codes binary, counts binary").repartition("word").sortWithinPartitions("word")
    placed = common.stored(beside.mapInArrow(_placed(table, classes, model.of[model.items :]), "word binary, n long, class int"), "placed")
    sent.destroy()
    per = placed.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect()
    model.place(placed.where(F.col("n") >= least).toArrow(), [(r["class"], r["n"], r["types"]) for r in per])
    sent = spark.sparkContext.broadcast(model)
    local = common.stored(d.select("doc_id", "learn", "text").mapInArrow(_local(sent), LOCAL), "local", 2000)
    sent.destroy()
    rare = local.select("rid", F.explode(F.arrays_zip("words", "places", "bundles")).alias("x")).select("rid", F.col("x.words").alias("word"), F.col("x.places").alias("places"), F.col("x.bundles").alias("b"))
    at = lambda x: F.element_at(F.array(*[F.lit(v) for v in x.tolist()]), F.col("b") + 1)
    mass = F.element_at(F.array(*[F.lit(v) for v in model.mass.tolist()]), F.col("class") + 1)
    off = F.element_at(F.array(*[F.lit(v) for v in model.off.tolist()]), F.col("class") + 1)
    known, c = F.col("n").isNotNull(), F.octet_length("places") / 4
    met = rare.join(placed.where(F.col("n") < least), "word", "left").select(
        "rid",
        F.struct("places", F.when(known, F.col("class")).otherwise(at(model.of[model.items :])).cast("int").alias("class")).alias("far"),
        F.when(known, c.cast("long")).otherwise(0).alias("known"),
        F.when(known, c * F.log10(F.col("n") + 1)).otherwise(0.0).alias("base"),
        (c * F.when(known, F.log10(F.col("n") - off) - F.log10(mass)).otherwise(at(model.unplaced))).alias("score"),
    )
    sums = met.groupBy(F.col("rid").alias("r")).agg(F.sum("known").alias("k"), F.sum("base").alias("b"), F.sum("score").alias("s"), F.collect_list("far").alias("far"))
    zero = F.lit(0.0)
    both = local.join(sums, F.col("r") == F.col("rid"), "left").select(
        "doc_id",
        "learn",
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("b", zero) - F.col("n_tokens") * float(np.log10(total + distinct + 1))).alias("base_score"),
        (F.col("score") + F.coalesce("s", zero)).alias("score"),
        "line",
        "far",
    )
    row = "doc_id long, learn boolean, n_tokens long, n_known long, base_score double, score double"
    lines = common.stored(both.mapInArrow(_filled, row + ", line binary"), "lines")
    common.spent(counts, placed, local)
    with common.batches_of(spark, 2000):
        pairs = _totals(lines.where("learn").select("line").mapInArrow(_followed(classes), "pair long, n long"), k * k).reshape(k, k)
    seen = pairs.sum(0) + 0.5
    step = np.log10((pairs + STRENGTH * seen / seen.sum()) / (pairs.sum(1, keepdims=True) + STRENGTH))
    scored = lines.mapInArrow(_stepped(step), row + ", steps double").select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", (F.col("score") + F.col("steps")).alias("score"))
    return common.stored(scored, "scores", keep=True)
