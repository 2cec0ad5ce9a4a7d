"""Aligns the tokens of two tokenizers on the bytes of a text, and counts which of them go together.

A is a byte-level tokenizer that gets a space and the text, B a SentencePiece
model that puts that space there itself; so the tokens of both cover the same
bytes.  The B tokens are a static index of intervals: two bisections, one in
their ends and one in their starts, stab it with each A token and list what it
overlaps.  A gap between B tokens that no A token spans is a boundary, where
both have a token's end; boundaries cut the tokens into groups.

Tokens of neither kind go over a space that follows a character which is no
white space (checked with the vocabularies), so a text is cut there, a word is
aligned once in a worker, and a text is the row of its words.

The links of a pair of ids are counted over all texts.  The most frequent
pairs, `hot` at most, go to all tasks as arrays; the counts of the others are
joined.  No text is moved.

Defined results: null and empty texts, and those that either tokenizer does
not give back byte by byte, have no tokens: zeros and an empty hash; null
doc_ids stay; rows that repeat are counted each; ties for the highest count of
a B id all count as best; texts of any length are aligned whole; an empty table
gives no rows; other columns may have any names.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: White space of any kind.
SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BATCH = 4 << 20
#: Words that are encoded in one row, and that a worker keeps.
ROW, KNOWN = 2000, 600_000
#: Words whose groups are put together at once.
BLOCK = 1 << 20
#: Pairs whose counts go to all tasks: 16 MB.
HOT = 1 << 20
SHIFT = 32
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys array<long>, counts array<int>"

_workers: dict[tuple[str, str], Aligner] = common.keeps(__name__)


def ragged(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ..., count[0] of them; then from begin[1] on, and so forth."""
    ends = np.cumsum(count)
    return np.repeat(begin - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def byte_of() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printed ones for themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Words to token ids; subclasses say how.  `size`: the bytes of each id; `opens`: ids that begin with a space."""

    def rows(self, words: list[str]) -> list[np.ndarray]:
        """The ids of rows of words, each with a space before it."""
        raise NotImplementedError

    def encode(self, words: pa.Array, simple: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words and how many each has; simple ones are encoded many in a row and cut before each id that begins with a space."""
        some, rest = (words.take(pa.array(np.flatnonzero(m))).to_pylist() for m in (simple, ~simple))
        parts = [some[i : i + ROW] for i in range(0, len(some), ROW)]
        ids, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part, row in zip(parts, self.rows([" ".join(p) for p in parts]), strict=True):
            at = np.flatnonzero(self.opens[row])
            if len(at) == len(part):
                n.append(np.diff(at, append=len(row)))
            else:
                each = self.rows(part)
                row = np.concatenate(each)
                n.append(np.array([len(x) for x in each], np.int64))
            ids.append(row)
        for row in self.rows(rest):
            ids.append(row)
            n.append(np.array([len(row)], np.int64))
        flat, count = np.concatenate(ids), np.concatenate(n)
        order = np.concatenate([np.flatnonzero(simple), np.flatnonzero(~simple)])
        begin, each = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        begin[order], each[order] = np.cumsum(count) - count, count
        return flat[ragged(begin, each)], each


    def text(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, one after the other."""
        return _bytes(self.table.take(pa.array(ids)))


def _bytes(strings: pa.Array) -> bytes:
    return memoryview(strings.buffers()[2] or b"")[: int(pc.sum(pc.binary_length(strings)).as_py() or 0)].tobytes()


class ByteLevel(Tokens):
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are plain text here
        signs = byte_of()
        vocab = self.tokenizer.get_vocab(True)
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(signs[c] for c in token) if all(c in signs for c in token) else token.encode()
        self.table = pa.array(self.bytes, pa.binary())
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        self.opens = np.array([b[:1] == b" " for b in self.bytes])

    def rows(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast([" " + w for w in words], add_special_tokens=False)]


class Pieces(Tokens):
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.table = pa.array(self.bytes, pa.binary())
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        self.opens = np.array([p[:1] == "▁" for p in pieces])
        self.space = self.model.piece_to_id("▁")  # what an empty word is, between two spaces or at a text's end
        #: Whether no piece goes over a space after another sign, and none is changed before.
        self.by_word = not any("▁" in p.lstrip("▁") for p in pieces) and self.model.encode("  a  b ", out_type=str, num_threads=1) and "".join(self.model.encode("  a  b ", out_type=str, num_threads=1)) == "▁▁▁a▁▁b▁"

    def rows(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(x or [self.space], np.int64) for x in self.model.encode(words, num_threads=1)]


def overlaps(a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For tokens of two kinds that cover the same bytes: the first B token that each A token overlaps, the one after the last, and whether both end together."""
    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
    low = np.searchsorted(b_end, a_end - a_size, "right")
    high = np.searchsorted(b_end - b_size, a_end, "left")
    return low, high, b_end[high - 1] == a_end if len(b_end) else np.zeros(0, bool)


class Aligner:
    """Words, aligned once each."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self._clear()

    def _clear(self) -> None:
        self.words = pa.array([], pa.string())
        self.groups = pa.array([], pa.string())
        #: Per word: A tokens, B tokens, groups, links, 1 if it is not given back; and where its links begin.
        self.sums, self.begin = np.zeros((5, 0), np.int64), np.zeros(0, np.int64)
        self.links, self.used = np.zeros(1 << 16, np.int64), 0
        #: The keys of pairs; links name them by their place.
        self.keys = pa.array([], pa.int64())

    def align(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Of distinct words: groups as text, sums, keys of links (id of A, id of B)."""
        simple = ~pc.match_substring_regex(words, f"^$| |▁|{SPACES}$").to_numpy(zero_copy_only=False)
        (a, na), (b, nb) = self.a.encode(words, simple), self.b.encode(words, simple)
        # the bytes of both, told apart word by word
        of_a, of_b = np.repeat(np.arange(len(words)), na), np.repeat(np.arange(len(words)), nb)
        size_a, size_b = self.a.size[a], self.b.size[b]
        bad = np.bincount(of_a, size_a, len(words)) != np.bincount(of_b, size_b, len(words))
        want = pc.binary_length(words).to_numpy() + 1
        bad |= np.bincount(of_a, size_a, len(words)) != want
        text_a, text_b = self.a.text(a), self.b.text(b)
        if bad.any() or text_a != text_b or text_a != _bytes(pc.binary_join_element_wise("", words, " ")):
            at_a, at_b = np.cumsum(np.concatenate([[0], np.bincount(of_a, size_a, len(words))])).astype(np.int64), np.cumsum(np.concatenate([[0], np.bincount(of_b, size_b, len(words))])).astype(np.int64)
            for i, w in enumerate(words.to_pylist()):
                own = b" " + w.encode()
                bad[i] = text_a[at_a[i] : at_a[i + 1]] != own or text_b[at_b[i] : at_b[i + 1]] != own
            a, size_a, of_a = (x[~bad[of_a]] for x in (a, size_a, of_a))
            b, size_b, of_b = (x[~bad[of_b]] for x in (b, size_b, of_b))
            na, nb = np.where(bad, 0, na), np.where(bad, 0, nb)
        low, high, ends = overlaps(size_a, size_b)
        links = high - low
        keys = np.repeat(a, links) << SHIFT | b[ragged(low, links)]
        # groups: B tokens up to the last one that each boundary's A token overlaps
        to_a, to_b = np.flatnonzero(ends) + 1, high[ends]
        both = pc.binary_join_element_wise(_joined(pc.cast(pa.array(a), pa.string()), to_a, ","), _joined(pc.cast(pa.array(b), pa.string()), to_b, ","), "|")
        n_groups = np.bincount(of_a[ends], minlength=len(words))
        n_links = np.bincount(of_a, links, len(words)).astype(np.int64)
        groups = _joined(both, np.cumsum(n_groups), ";")
        return groups, np.stack([na, nb, n_groups, n_links, bad.astype(np.int64)]), keys

    def places(self, words: pa.Array) -> np.ndarray:
        """Where distinct words are kept; new ones are aligned."""
        if len(self.words) > KNOWN:
            self._clear()
        at = pc.index_in(words, value_set=self.words)
        new = np.flatnonzero(pc.is_null(at).to_numpy(zero_copy_only=False))
        places = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        if len(new):
            places[new] = len(self.words) + np.arange(len(new))
            some = words.take(pa.array(new))
            groups, sums, keys = self.align(some)
            if self.used + len(keys) > len(self.links):
                self.links = np.concatenate([self.links[: self.used], np.zeros(self.used + len(keys), np.int64)])
            self.links[self.used : self.used + len(keys)] = self.pairs(keys)
            self.begin = np.concatenate([self.begin, self.used + np.cumsum(sums[3]) - sums[3]])
            self.used += len(keys)
            self.sums = np.concatenate([self.sums, sums], axis=1)
            self.words, self.groups = pa.concat_arrays([self.words, some]), pa.concat_arrays([self.groups, groups])
        return places

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        """The places of the pairs' keys; new ones are kept."""
        own = pa.array(keys).dictionary_encode()
        at = pc.index_in(own.dictionary, value_set=self.keys)
        new = np.flatnonzero(pc.is_null(at).to_numpy(zero_copy_only=False))
        places = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        places[new] = len(self.keys) + np.arange(len(new))
        self.keys = pa.concat_arrays([self.keys, own.dictionary.take(pa.array(new))])
        return places[own.indices.to_numpy()]

    def texts(self, texts: pa.Array) -> dict:
        """Of each text: its sums, groups_sha256, and its distinct keys (`ends` tells where each text's end) with their counts."""
        own, cuts = split(texts, self.b.by_word)
        words = own.dictionary_encode()
        at = self.places(words.dictionary)[words.indices.to_numpy()]
        upto = np.zeros((5, len(at) + 1), np.int64)
        np.cumsum(self.sums[:, at], axis=1, out=upto[:, 1:])
        sums = upto[:, cuts[1:]] - upto[:, cuts[:-1]]
        sums[:4, sums[4] > 0] = 0
        good = (sums[4] == 0) & (np.diff(cuts) > 0)
        hashes = [self._hash(at[i:j]) if ok else "" for i, j, ok in zip(cuts[:-1].tolist(), cuts[1:].tolist(), good.tolist(), strict=True)]
        count = np.where(np.repeat(good, np.diff(cuts)), self.sums[3, at], 0)
        doc = np.repeat(np.repeat(np.arange(len(good)), np.diff(cuts)), count)
        size = max(1, len(self.keys))
        code = np.sort(doc * size + self.links[ragged(self.begin[at], count)])
        first = np.flatnonzero(np.diff(code, prepend=-1))
        doc, where = code[first] // size, code[first] % size
        n = np.diff(first, append=len(code))
        return {"sums": sums[:4], "sha": hashes, "keys": self.keys.to_numpy()[where], "counts": n, "ends": np.searchsorted(doc, np.arange(len(good)), "right")}

    def _hash(self, at: np.ndarray) -> str:
        h = hashlib.sha256()
        for i in range(0, len(at), BLOCK):
            if i:
                h.update(b";")
            some = at[i : i + BLOCK]
            h.update(_joined(self.groups.take(pa.array(some)), np.array([len(some)]), ";")[0].as_buffer())
        return h.hexdigest()


def _joined(strings: pa.Array, ends: np.ndarray, between: str) -> pa.Array:
    """Strings joined in runs that end at `ends`."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), strings), between)


def split(texts: pa.Array, by_word: bool = True) -> tuple[pa.Array, np.ndarray]:
    """The words of texts, cut at each space that follows no white space (a space is then before each word), and where each text's begin and end."""
    blank = pc.equal(texts, "").to_numpy(zero_copy_only=False)
    odd = np.ones(len(texts), bool) if not by_word else pc.match_substring_regex(texts, f"^ |{SPACES} ").to_numpy(zero_copy_only=False)
    plain = pc.split_pattern(pc.if_else(odd | blank, "", texts), " ")
    count = np.diff(plain.offsets.to_numpy()).astype(np.int64)
    count[blank] = 0
    values = plain.values.filter(pa.array(np.repeat(~(odd | blank), np.diff(plain.offsets.to_numpy()))))
    if not odd.any():
        return values, np.concatenate([[0], np.cumsum(count)])
    # words of odd texts stand in for them
    where = np.flatnonzero(odd)
    lists = [_words(texts[i].as_py()) if by_word else [texts[i].as_py()] for i in where.tolist()]
    begin = np.zeros(len(texts), np.int64)
    count[odd] = 0
    begin[~odd] = np.cumsum(count[~odd]) - count[~odd]
    more = np.array([len(x) for x in lists])
    begin[where], count[where] = len(values) + np.cumsum(more) - more, more
    every = pa.concat_arrays([values, pa.array([w for x in lists for w in x], pa.string())])
    return every.take(pa.array(ragged(begin, count))), np.concatenate([[0], np.cumsum(count)])


def _words(text: str) -> list[str]:
    parts = text.split(" ")
    found = [parts[0]]
    for p in parts[1:]:
        if not found[-1] or found[-1][-1].isspace():
            found[-1] += " " + p
        else:
            found.append(p)
    return found


def _aligned(a_path: str, b_path: str):
    @common.tidy
    def run(batches):
        key = a_path, b_path
        if key not in _workers:
            _workers[key] = Aligner(*key)
        worker = _workers[key]
        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("keys", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32()))])
        for batch in batches:
            for some in common.sized_batches(batch, "text", BATCH):
                t = worker.texts(some.column("text"))
                ends = pa.array(np.concatenate([[0], t["ends"]]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(t[c].astype(kind))) for c, kind in (("keys", np.int64), ("counts", np.int32))]
                yield pa.RecordBatch.from_arrays([some.column("row"), some.column("doc_id"), *map(pa.array, t["sums"]), pa.array(t["sha"], pa.string()), *lists], schema=schema)

    return run


def _told(hot, best, shift: int):
    """Sums over the links whose pair is among the hot ones; the others go on."""

    @common.tidy
    def run(batches):
        keys, counts = hot.value
        highest = best.value
        for b in batches:
            lists = b.column("keys")
            flat, n = lists.flatten().to_numpy(), b.column("counts").flatten().to_numpy().astype(np.int64)
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            doc = np.repeat(np.arange(b.num_rows), np.diff(ends))
            at = np.minimum(np.searchsorted(keys, flat), max(0, len(keys) - 1))
            known = keys[at] == flat if len(keys) else np.zeros(len(flat), bool)
            c = np.where(known, counts[at] if len(keys) else 0, 0)
            top = known & (c == highest[flat & ((1 << shift) - 1)])
            upto = np.zeros((2, len(flat) + 1), np.int64)
            np.cumsum(n * top, out=upto[0, 1:])
            np.cumsum(n * c, out=upto[1, 1:])
            sums = upto[:, ends[1:]] - upto[:, ends[:-1]]
            rest = np.cumsum(np.bincount(doc[~known], minlength=b.num_rows))
            offsets = pa.array(np.concatenate([[0], rest]).astype(np.int32))
            cold = [pa.ListArray.from_arrays(offsets, pa.array(x[~known])) for x in (flat, n)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")], pa.array(sums[0]), pa.array(sums[1]), *cold], names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "keys", "counts"])

    return run


class Alignment:
    """Alignment of docs(doc_id, text); a and b are the tokenizers' files.

    Keeps a row for each text with its distinct pairs of ids.
    """

    def __init__(self, docs: DataFrame, a: str, b: str, hot: int = HOT):
        spark = docs.sparkSession
        d = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        with common.batches_of(spark, 10_000, BATCH):
            self.rows = common.stored(d.mapInArrow(_aligned(a, b), ALIGNED), "aligned", 10_000)
        each = self.rows.select(F.explode(F.arrays_zip("keys", "counts")).alias("x")).select(F.col("x.keys").alias("key"), F.col("x.counts").alias("n"))
        self.pairs = common.stored(each.groupBy("key").agg(F.sum("n").alias("count")), "pairs")
        self.hot = hot

    def counts(self) -> DataFrame:
        """a_id, b_id, count: how many links hold the two ids linked."""
        return self.pairs.select(F.shiftright("key", SHIFT).alias("a_id"), F.col("key").bitwiseAND(F.lit((1 << SHIFT) - 1)).alias("b_id"), "count")

    def table(self) -> DataFrame:
        """b_id, a_id, count: the A id that each B id is linked with most (of ties the smallest)."""
        best = F.max(F.struct("count", (-F.col("a_id")).alias("minus")))
        return self.counts().groupBy("b_id").agg(best.alias("m")).select("b_id", (-F.col("m.minus")).alias("a_id"), F.col("m.count").alias("count"))

    def _hot(self):
        """The least power of two from which on the pairs are few enough for all tasks; and those pairs."""
        log = F.floor(F.log2("count")).cast("int")
        sizes = {r["p"]: r["m"] for r in self.pairs.groupBy(log.alias("p")).agg(F.count("*").alias("m")).collect()}  # a row for each power
        least, total = 64, 0
        for p in sorted(sizes, reverse=True):
            if total + sizes[p] > self.hot:
                break
            least, total = p, total + sizes[p]
        some = self.pairs.where(log >= least).select("key", "count").toArrow()
        order = np.argsort(some["key"].to_numpy())
        return log < least, total < sum(sizes.values()), some["key"].to_numpy()[order].astype(np.int64), some["count"].to_numpy()[order].astype(np.int64)

    def report(self) -> DataFrame:
        """Per text: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
        sc = self.pairs.sparkSession.sparkContext
        cold, any_cold, keys, counts = self._hot()
        best = self.counts().groupBy("b_id").agg(F.max("count").alias("m")).toArrow()  # a row for each B id at most
        highest = np.zeros(1 + max(best["b_id"].to_pylist(), default=0), np.int64)
        highest[best["b_id"].to_numpy()] = best["m"].to_numpy()
        told = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, keys array<long>, counts array<long>"
        rows = self.rows.mapInArrow(_told(sc.broadcast((keys, counts)), sc.broadcast(highest), SHIFT), told)
        out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        if not any_cold:
            return rows.select(*out)
        rows = common.stored(rows, "told", 1000)
        x = rows.select("row", F.explode(F.arrays_zip("keys", "counts")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.counts").alias("n"))
        tops = self.counts().groupBy("b_id").agg(F.max("count").alias("top"))
        known = self.pairs.where(cold).withColumn("b_id", F.col("key").bitwiseAND(F.lit((1 << SHIFT) - 1))).join(tops, "b_id").select("key", "count", (F.col("count") == F.col("top")).alias("best"))
        more = x.join(known, "key").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("m_best"), F.sum(F.col("n") * F.col("count")).alias("m_sum"))
        both = rows.join(more, "row", "left")
        return both.select(*out[:5], (F.col("n_best") + F.coalesce("m_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("m_sum", F.lit(0))).alias("count_sum"), "groups_sha256")
