"""Packs documents into sequences of equal length whose mixture of sources is controlled.

Each source has a queue of its documents' tokens.  Deficit round-robin serves
the queues a quantum at a time: with every quantum packed a queue's deficit
grows by its share, and falls by one when it is served, so that each window of
`window` tokens has its sources near their target proportions and what one
window lacks the next makes up for.  As shares are fixed, the turn in which the
j-th quantum of a queue is served has a closed form: quanta stand in the order
of (2j + 1) / 2w, w the queue's weight (equal ones by queue).  A task therefore
starts with the deficits that all windows and partitions before it leave,
without waiting for them; only a sum of tokens for each shard and source is
needed first.  Within a window the quanta of a queue stand together, so a
document is cut where the window's share of its source ends and nowhere else.

What is left when no full window can be made (the last quanta, and less than a
quantum of each queue) is packed in the queues' order, the last part of it in
sequences whose lengths are powers of two, which need no padding.

Defined results: null text is the empty text (just the end id); a null source
is a source of its own; a null doc_id stays null; rows that repeat are packed
each; texts of any length are packed whole, over as many sequences as they
need; an empty table gives no rows; other columns may have any names.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bytes of the texts that are encoded together.
BATCH = 8 << 20
#: Words whose ids a worker keeps.
KNOWN = 500_000
#: Stems that the library encodes in one row.
ROW = 2000
#: Marks that stand at the ends of words; none of them begins a pattern of its own.
MARKS = '.,;:!?%#&*$)"'
#: Letters whose lower case and normal form depend on nothing beside them.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: Bytes of such letters that byte-level vocabularies do not write as they are, and how they do.
BYTES = [(chr(b), chr(289 + b - 127)) for b in range(128, 161)] + [(chr(173), chr(323))]
#: Shards whose sums are added up in one task.
GROUP = 1024
ENCODED = "doc_id long, source string, shard int, pos long, n int, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, queue int, at long, ids array<int>"

_encoders: dict[str, Words] = common.keeps(__name__)


def gathered(flat: np.ndarray, begin: np.ndarray, count: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words at some places, one after the other, and how many each has."""
    each = count[at]
    ends = np.cumsum(each)
    return flat[np.repeat(begin[at] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)], each


def _printed(row: str) -> str:
    """A row of stems as byte-level vocabularies write them."""
    if not row.isascii():
        row = row.encode().decode("latin-1")
        for byte, sign in BYTES:
            row = row.replace(byte, sign)
    return row


class Known:
    """Words and their ids, as arrays; begins anew when there are more than KNOWN."""

    def __init__(self):
        self.words = pa.array([], pa.string())
        self.flat, self.used = np.zeros(1 << 16, "<u4"), 0
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def places(self, words: pa.Array, encode) -> np.ndarray:
        """Where distinct words are; new ones are encoded and kept."""
        if len(self.words) > KNOWN:
            self.__init__()
        at = pc.index_in(words, value_set=self.words)
        new = np.flatnonzero(pc.is_null(at).to_numpy(zero_copy_only=False))
        places = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        if len(new):
            places[new] = len(self.words) + np.arange(len(new))
            some = words.take(pa.array(new))
            ids, n = encode(some)
            if self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used + len(ids), "<u4")])
            self.flat[self.used : self.used + len(ids)] = ids
            self.begin = np.concatenate([self.begin, self.used + np.cumsum(n) - n])
            self.count = np.concatenate([self.count, n])
            self.used += len(ids)
            self.words = pa.concat_arrays([self.words, some])
        return places


class Words:
    """Encodes texts with the tokenizers library, each word once.

    A tokenizer that drops white space encodes the words around it alone; for
    other kinds whole texts are encoded.  Where its words are runs of letters
    or of marks, each with an end of its own, so do stems of plain letters and
    the marks after them; stems are then encoded many in a row.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        pre = kind.get("pre_tokenizer") or {}
        first = (pre.get("pretokenizers") or [pre])[0]
        pattern = (first.get("pattern") or {}).get("Regex", "")
        added = kind.get("added_tokens", [])
        self.by_word = bool(
            first.get("type") == "Split"
            and first.get("behavior") == "Removed"
            and first.get("invert")
            and r"[^\s" in pattern
            and r"\s" not in pattern.replace(r"[^\s", "")
            and " " not in pattern
            and not any(" " in t["content"] or "\n" in t["content"] or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added)
        )
        others = [x for x in pattern.split("|") if not x.startswith("'")]
        suffix = kind["model"].get("end_of_word_suffix")
        lowers = any(n.get("type") == "Lowercase" for n in (kind.get("normalizer") or {}).get("normalizers", []))
        self.by_stem = bool(self.by_word and suffix and lowers and others == [r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"] and not any(c.isalnum() and c.isascii() and t["content"].isalnum() or c in MARKS for t in added for c in t["content"]))
        self.tokenizer = Tokenizer.from_file(path)
        if self.by_stem:  # stems in small letters need no normalizing and no pattern
            from tokenizers import pre_tokenizers

            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer = None
            self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(max(self.tokenizer.get_vocab(True).values(), default=0) + 1, bool)
        if suffix:
            for token, i in self.tokenizer.get_vocab(False).items():
                self.ends[i] = token.endswith(suffix)
        self.words, self.stems = Known(), Known()

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, "<u4"), *each]), np.array([len(x) for x in each], np.int64)

    def _stems(self, stems: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stems and how many each has: rows of them, cut after each token that ends a word.  The empty one has none."""
        some = [s for s in stems.to_pylist() if s]
        rows = [some[i : i + ROW] for i in range(0, len(some), ROW)]
        ids, n = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for row, e in zip(rows, self.plain.encode_batch_fast([_printed(" ".join(r)) for r in rows], add_special_tokens=False), strict=True):
            own = np.array(e.ids, "<u4")
            at = np.flatnonzero(self.ends[own])
            own, count = (own, np.diff(at, prepend=-1)) if len(at) == len(row) else self._ids(row)
            ids.append(own)
            n.append(count)
        count = np.zeros(len(stems), np.int64)
        count[pc.not_equal(stems, "").to_numpy(zero_copy_only=False)] = np.concatenate(n)
        return np.concatenate(ids), count

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words and how many each has."""
        if not self.by_stem:
            return self._ids(words.to_pylist())
        plain = pc.match_substring_regex(words, f"^[{LETTERS}]+[{re.escape(MARKS)}]*$")
        stems = pc.if_else(plain, pc.utf8_lower(pc.utf8_rtrim(words, MARKS)), "").dictionary_encode()
        tails = pc.if_else(plain, pc.replace_substring_regex(words, f"^[{LETTERS}]+", ""), words).dictionary_encode()
        at = self.stems.places(stems.dictionary, self._stems)[stems.indices.to_numpy()]
        flat, n = self._ids(tails.dictionary.to_pylist())
        parts = np.empty((len(words), 2), np.int64)
        parts[:, 0], parts[:, 1] = at, len(self.stems.count) + tails.indices.to_numpy()
        begin, count = np.concatenate([self.stems.begin, self.stems.used + np.cumsum(n) - n]), np.concatenate([self.stems.count, n])
        ids, each = gathered(np.concatenate([self.stems.flat[: self.stems.used], flat]), begin, count, parts.ravel())
        return ids, each.reshape(-1, 2).sum(axis=1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        if not self.by_word:
            return self._ids(texts.to_pylist())
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = lists.values.dictionary_encode()
        at = self.words.places(words.dictionary, self._words)[words.indices.to_numpy()]
        ids, each = gathered(self.words.flat, self.words.begin, self.words.count, at)
        upto, cuts = np.concatenate([[0], np.cumsum(each)]), lists.offsets.to_numpy()
        return ids, upto[cuts[1:]] - upto[cuts[:-1]]


def words(path: str) -> Words:
    """One for each Python worker, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Words(path)
    return _encoders[path]


def _encoded(tokenizer: str, end_id: int):
    """doc_id, source, its shard (the task), tokens of its source before it in that shard, and its ids."""

    @common.tidy
    def run(batches):
        from pyspark import TaskContext

        shard, coder = TaskContext.get().partitionId(), words(tokenizer)
        before: dict[str | None, int] = {}
        schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("shard", pa.int32()), ("pos", pa.int64()), ("n", pa.int32()), ("ids", pa.binary())])
        for batch in batches:
            for some in common.sized_batches(batch, "text", BATCH):
                flat, n = coder.encode(some.column("text"))
                n = n + 1
                ends = np.cumsum(n)
                ids = np.full(int(ends[-1]), end_id, "<u4")
                own = np.ones(len(ids), bool)
                own[ends - 1] = False
                ids[own] = flat
                pos = np.zeros(len(n), np.int64)
                for i, s in enumerate(some.column("source").to_pylist()):
                    pos[i] = before.get(s, 0)
                    before[s] = int(pos[i] + n[i])
                offsets = pa.py_buffer(np.concatenate(([0], 4 * ends)).astype(np.int32))
                binary = pa.Array.from_buffers(pa.binary(), len(n), [None, offsets, pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("source"), pa.array(np.full(len(n), shard, np.int32)), pa.array(pos), pa.array(n.astype(np.int32)), binary], schema=schema)

    return run


class Schedule:
    """Which sequence each token of each queue goes to.

    tokens: of each queue; weights: target shares (as the tokens are, if there
    are none).  A queue that ends leaves its share to the others.
    """

    def __init__(self, tokens: list[int], weights: list[float] | None = None, window: int = 2048, quantum: int = 64):
        if window % quantum or window & (window - 1):
            raise ValueError("window must be a power of two and a multiple of quantum")
        self.window, self.quantum, self.per = window, quantum, window // quantum
        self.tokens = np.array(tokens, np.int64)
        self.units = self.tokens // quantum
        self.weights = np.maximum(self.units, 1).astype(float) if weights is None else np.array(weights, float)
        if len(self.weights) and not (np.isfinite(self.weights) & (self.weights > 0)).all():
            raise ValueError("weights must be positive")
        self.windows = int(self.units.sum()) // self.per
        # the quanta beyond the last full window are among the last ones of each queue
        late = [(self.time(q, j), q, j) for q in range(len(tokens)) for j in range(max(0, int(self.units[q]) - self.per), int(self.units[q]))]
        left = int(self.units.sum()) - self.windows * self.per
        self.full = self.units.copy()  # quanta in full windows
        for _, q, _ in sorted(late)[len(late) - left :]:
            self.full[q] -= 1
        rest = self.tokens - self.full * quantum
        self.tail = np.concatenate([[0], np.cumsum(rest)])  # where each queue's rest begins among all of them
        end = int(self.tail[-1])
        bounds = list(range(0, end - end % window + 1, window))
        for bit in range(window.bit_length() - 2, -1, -1):
            if end % window >> bit & 1:
                bounds.append(bounds[-1] + (1 << bit))
        self.bounds = np.array(bounds, np.int64)

    def time(self, q: int, j: np.ndarray | int):
        """When the j-th quantum is due; a correctly rounded quotient, so the same everywhere."""
        return (2.0 * np.asarray(j) + 1) / (2 * self.weights[q])

    def _before(self, q: int, t: np.ndarray, ties: bool) -> np.ndarray:
        """How many quanta of a queue are due before t (or at t)."""
        most = self.units[q]
        due = (lambda c: self.time(q, c) <= t) if ties else (lambda c: self.time(q, c) < t)
        c = np.clip(np.floor(t * self.weights[q] + 0.5), 0, most).astype(np.int64)
        while (up := (c < most) & due(c)).any():
            c += up
        while (down := (c > 0) & ~due(c - 1)).any():
            c -= down
        return c

    def turn(self, q: int, j: np.ndarray) -> np.ndarray:
        """The place of the j-th quanta of a queue among those of all queues."""
        t, own = self.time(q, j), np.array(j, np.int64)
        return own + sum((self._before(p, t, p < q) for p in range(len(self.units)) if p != q and self.units[p]), np.zeros(len(own), np.int64))

    def cut(self, q: int, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of documents that have n tokens from `at` of their queue on: document, start in it, length, sequence."""
        end, edge = at + n, self.full[q] * self.quantum
        stop = np.minimum(end, edge)
        first = at // self.quantum
        count = np.maximum(0, (stop + self.quantum - 1) // self.quantum - first)
        doc = np.repeat(np.arange(len(at)), count)
        j = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[doc]
        some, where = np.unique(j, return_inverse=True)
        sequence = (self.turn(q, some) // self.per)[where] if len(some) else np.zeros(0, np.int64)
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (sequence[1:] != sequence[:-1])
        doc, sequence, begin = doc[new], sequence[new], np.maximum(at[doc], j * self.quantum)[new]
        # within a document a piece ends where the next begins
        ends = stop[doc]
        ends[:-1] = np.where(doc[1:] == doc[:-1], begin[1:], ends[:-1])
        found = [(doc, begin - at[doc], ends - begin, sequence)]
        for i in np.flatnonzero(end > edge).tolist():
            low = int(self.tail[q] + max(at[i] - edge, 0))
            high = int(self.tail[q] + end[i] - edge)
            k = int(np.searchsorted(self.bounds, low, "right")) - 1
            while low < high:
                to = min(high, int(self.bounds[k + 1]))
                found.append((np.array([i]), np.array([low - self.tail[q] + edge - at[i]]), np.array([to - low]), np.array([self.windows + k])))
                low, k = to, k + 1
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _pieces(schedule: Schedule, with_ids: bool):
    @common.tidy
    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("queue", pa.int32()), ("at", pa.int64()), ("ids", pa.list_(pa.int32()))])
        for whole in batches:
            for b in common.sized_batches(whole, "ids", BATCH):
                at, n, queues = (b.column(c).to_numpy() for c in ("at", "n", "queue"))
                ids, offsets = memoryview(b.column("ids").buffers()[2] or b""), np.frombuffer(b.column("ids").buffers()[1], np.int32)[b.column("ids").offset :]
                for q in np.unique(queues).tolist():
                    own = np.flatnonzero(queues == q)
                    doc, start, length, sequence = schedule.cut(q, at[own], n[own].astype(np.int64))
                    row = own[doc]
                    order = np.lexsort((start, row))
                    row, start, length, sequence = row[order], start[order], length[order], sequence[order]
                    low = offsets[row] + 4 * start
                    high = low + 4 * length
                    spans = list(zip(low.tolist(), high.tolist(), strict=True))
                    crc = pa.array([zlib.crc32(ids[i:j]) for i, j in spans], pa.int64())
                    lists = pa.array([np.frombuffer(ids[i:j], "<i4") for i, j in spans], pa.list_(pa.int32())) if with_ids else pa.nulls(len(row), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length), crc, pa.array(n[row].astype(np.int64)), pa.array(sequence), pa.array(np.full(len(row), q, np.int32)), pa.array(at[row] + start), lists], schema=schema)

    return run


class Packing:
    """Documents docs(doc_id, text, source) in sequences of `window` tokens.

    weights: target shares by source (any others have the share 1 of their
    sum); without them each source has its share of all tokens, so that all
    windows are alike from the first to the last.  The `queues` largest sources
    have queues of their own, all others share one: no source is left out, and
    the schedule that goes to every task has so many numbers at most.
    """

    def __init__(self, docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048, quantum: int = 64, weights: dict[str | None, float] | None = None, queues: int = 1024):
        d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("text"))
        self.window = window
        self.encoded = common.stored(d.mapInArrow(_encoded(tokenizer, end_id), ENCODED), "encoded", 10_000)
        runs = common.stored(self.encoded.groupBy("shard", "source").agg(F.sum("n").alias("n")), "runs")
        totals = runs.groupBy("source").agg(F.sum("n").alias("n"))
        top = totals.orderBy(F.desc("n"), F.asc_nulls_last("source")).limit(queues).collect()
        top = sorted(top, key=lambda r: (r["source"] is None, r["source"] or ""))
        rest = (runs.agg(F.sum("n")).first()[0] or 0) - sum(r["n"] for r in top)
        names = [r["source"] for r in top]
        shares = None if weights is None else [weights.get(s, 1.0) for s in [*names, None]][: len(names)] + [1.0]
        self.schedule = Schedule([*[r["n"] for r in top], rest], shares, window, quantum)
        self.sources = [*names, None]
        named = docs.sparkSession.createDataFrame([(s, i) for i, s in enumerate(names)], "s string, queue int")
        runs = runs.join(F.broadcast(named), F.col("s").eqNullSafe(F.col("source")), "left").select("shard", "source", "n", F.coalesce("queue", F.lit(len(names))).alias("queue"))
        self.starts = common.stored(_starts(runs), "starts")

    def pieces(self, ids: bool = False) -> DataFrame:
        """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, its ids."""
        at = common.near(self.starts.withColumnRenamed("source", "s").withColumnRenamed("shard", "k"))
        placed = self.encoded.join(at, (F.col("k") == F.col("shard")) & F.col("s").eqNullSafe(F.col("source")))
        placed = placed.select("doc_id", "queue", (F.col("begin") + F.col("pos")).alias("at"), "n", "ids")
        cut = placed.mapInArrow(_pieces(self.schedule, ids), PIECES)
        before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("queue", "at")) - F.col("length")
        return cut.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", before.alias("offset"), *(["ids"] if ids else []), "queue")

    def sequences(self, pad: int = 0) -> DataFrame:
        """sequence_id, n_tokens, ids padded to the window (none at a length that is a power of two), and its segments (offset, length, doc_id, start)."""
        own = self.pieces(ids=True)
        parts = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "start", "ids")))
        s = own.groupBy("sequence_id").agg(parts.alias("p"), F.sum("length").alias("n_tokens"))
        short = F.when(F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0, F.lit(0)).otherwise(self.window - F.col("n_tokens"))
        ids = F.concat(F.flatten("p.ids"), F.array_repeat(F.lit(pad), short.cast("int")))
        return s.select("sequence_id", "n_tokens", ids.alias("ids"), F.transform("p", lambda x: F.struct(x["offset"].alias("offset"), x["length"].alias("length"), x["doc_id"].alias("doc_id"), x["start"].alias("start"))).alias("segments"))


def _starts(runs: DataFrame) -> DataFrame:
    """runs(shard, source, n, queue) with `begin`, the tokens of the queue before each; sums over groups of shards first."""
    r = runs.withColumn("g", F.floor(F.col("shard") / GROUP))
    groups = r.groupBy("queue", "g").agg(F.sum("n").alias("m"))
    groups = groups.select(F.col("queue").alias("gq"), F.col("g").alias("gg"), (F.sum("m").over(Window.partitionBy("queue").orderBy("g")) - F.col("m")).alias("base"))
    inside = F.sum("n").over(Window.partitionBy("queue", "g").orderBy("shard", F.asc_nulls_last("source"))) - F.col("n")
    return r.withColumn("inside", inside).join(groups, (F.col("gq") == F.col("queue")) & (F.col("gg") == F.col("g"))).select("shard", "source", "queue", (F.col("base") + F.col("inside")).alias("begin"))
