"""Token ids in ORC: run-length coded integers, row indexes, Bloom filters.

Files hold one row per document, in ascending doc_id order over all
shards: doc_id, shard, pos (ids before the document within its shard),
n_tokens and ids.  ORC codes `ids` with its integer run-length encoding, keeps
min/max of doc_id for each stripe and row group, and a Bloom filter on doc_id,
so readers take stripes in parallel and skip those that hold no wanted id.

Defined results: null text encodes as the empty text (just the end id); a null
doc_id sorts first; rows that repeat are kept, one entry each; an empty table
gives no rows; texts of any length are encoded whole; columns beside doc_id and
text are left out, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: White space of any kind; a text can't be cut at a space or line end that follows one.
SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Bytes of the texts that are encoded together: more have more words in common.
BATCH = 4 << 20
#: Marks that stand at the ends of words.
TAILS = ".,;:!?%#&*$)\"'"
#: Pieces that the library encodes in one row.
ROW = 2000
STORED = "doc_id long, shard int, pos long, n_tokens int, ids array<int>"

_encoders: dict[str, Encoder] = common.keeps(__name__)


class Encoder:
    """Encodes with the tokenizers library, equal words of a batch of texts once.

    A byte-level tokenizer splits text by a pattern that never carries a token
    from a non-space character over the space after it.  There the text can be
    cut and the pieces encoded alone; cutting, finding equal ones and putting
    ids together is done on arrays.  For other kinds of tokenizer whole texts
    are encoded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        pre = kind.get("pre_tokenizer") or {}
        special = [t["content"] for t in kind.get("added_tokens", [])]
        self.by_word = (
            kind.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and not any(" " in s for s in special)
            and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in kind.get("added_tokens", []))
        )
        self.by_tail = not any(set(TAILS) & set(s) for s in special)
        self.known: dict[str, np.ndarray] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.opens = np.zeros(max(self.tokenizer.get_vocab(True).values(), default=0) + 1, bool)  # tokens that begin with a space or line end
        for token, i in self.tokenizer.get_vocab(False).items():
            self.opens[i] = token.startswith(("\u0120", "\u010a"))

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: pa.Array, between: str) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of all pieces, and how many each has; `between` stands before each, or they begin with a line end.

        Pieces are encoded in long rows, cut again before each token that begins with a space or line end.
        """
        cuts = np.append(np.arange(0, len(pieces), ROW), len(pieces)).astype(np.int32)
        rows = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), pieces), between).to_pylist() if len(pieces) else []
        ids, n = [], [np.zeros(0, np.int64)]
        for k, row in enumerate(self._ids([between + r for r in rows])):
            at = np.flatnonzero(self.opens[row])
            if len(at) == cuts[k + 1] - cuts[k]:
                n.append(np.diff(np.append(at, len(row))))
            else:
                each = self._ids([between + p for p in pieces.slice(cuts[k], cuts[k + 1] - cuts[k]).to_pylist()])
                row = np.concatenate(each)
                n.append(np.array([len(x) for x in each]))
            ids.append(row)
        return ids, np.concatenate(n)

    def _cut(self, pieces: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Pieces without the marks at their ends, and those marks: no token goes over from a letter or digit to a mark."""
        stems = pc.utf8_rtrim(pieces, TAILS)
        cut = pc.match_substring_regex(stems, "[A-Za-z0-9À-ÖØ-öø-ÿ]$") if self.by_tail else pa.array(np.zeros(len(pieces), bool))
        tails = pc.if_else(cut, pc.replace_substring_regex(pieces, f"^(?s:.*)[^{re.escape(TAILS)}]", ""), "")
        return pc.if_else(cut, stems, pieces), tails

    def _tail(self, marks: str) -> np.ndarray:
        if len(self.known) > 100_000:
            self.known.clear()
        if marks not in self.known:
            self.known[marks] = self._ids([marks])[0]
        return self.known[marks]

    def _pieces(self, pieces: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Ids of pieces in some order, and where those of each begin and how many they are; one that does not begin with a line end has a space before it."""
        line = pc.starts_with(pieces, "\n").to_numpy(zero_copy_only=False)
        odd = pc.match_substring_regex(pieces, f"^$|{SPACES}$").to_numpy(zero_copy_only=False)
        some = [np.flatnonzero(m) for m in (~line & ~odd, line & ~odd, odd)]
        ids, n = self._joined(pieces.take(pa.array(some[0])), " ")
        more, m = self._joined(pieces.take(pa.array(some[1])), "")
        rest = self._ids([w if w[:1] == "\n" else " " + w for w in pieces.take(pa.array(some[2])).to_pylist()])
        order, sizes = np.concatenate(some), np.concatenate([n, m, [len(x) for x in rest]]).astype(np.int64)
        count, begin = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        count[order], begin[order] = sizes, np.cumsum(sizes) - sizes
        return ids + more + rest, begin, count

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        none = np.zeros(0, "<u4")
        if not self.by_word or not len(texts):
            ids = self._ids(texts.to_pylist())
            return np.concatenate([none, *ids]), np.array([len(x) for x in ids], np.int64)
        whole = pc.match_substring_regex(texts, f"{SPACES}[ \n]")
        lists = pc.split_pattern(pc.if_else(whole, "", pc.replace_substring(texts, "\n", " \n")), " ")
        at, words = lists.offsets.to_numpy()[:-1], lists.values.dictionary_encode()
        take = words.indices.to_numpy().astype(np.int64)
        # a first piece has nothing before it; a text that can't be cut is one
        heads = words.dictionary.take(pa.array(take[at])).to_pylist()
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            heads[i] = texts[i].as_py()
        stems, tails = (x.dictionary_encode() for x in self._cut(words.dictionary))
        ids, begin, n = self._pieces(stems.dictionary)
        rest = [none, *map(self._tail, tails.dictionary.to_pylist()), *self._ids(heads)]
        size = np.array([len(x) for x in rest], np.int64)
        begin, n, base = np.concatenate([begin, n.sum() + np.cumsum(size) - size]), np.concatenate([n, size]), len(n)
        # a word is a stem and a tail; the first piece of a text is followed by nothing
        parts = np.empty((len(take), 2), np.int64)
        parts[:, 0], parts[:, 1] = stems.indices.to_numpy()[take], base + 1 + tails.indices.to_numpy()[take]
        parts[at, 0], parts[at, 1] = len(n) - len(heads) + np.arange(len(heads)), base
        parts = parts.ravel()
        each = n[parts]
        ends = np.cumsum(each)
        return np.concatenate([none, *ids, *rest])[np.repeat(begin[parts] - (ends - each), each) + np.arange(ends[-1])], np.add.reduceat(each, 2 * at)


def encoder(path: str) -> Encoder:
    """One for each Python worker, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _encoded(tokenizer: str, end_id: int):
    @common.tidy
    def run(batches):
        from pyspark import TaskContext

        shard, pos, coder = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        schema = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("pos", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.list_(pa.int32()))])
        for batch in batches:
            for some in common.sized_batches(batch, "text", BATCH):
                flat, n = coder.encode(some.column("text"))
                n = n + 1  # with the end
                ends = np.cumsum(n)
                ids = np.full(int(ends[-1]), end_id, np.int32)
                own = np.ones(len(ids), bool)
                own[ends - 1] = False
                ids[own] = flat
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(np.full(len(n), shard, np.int32)), pa.array(pos + ends - n), pa.array(n.astype(np.int32)), lists], schema=schema)
                pos += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard_bytes: int = 16 << 20, stripe_bytes: int = 4 << 20, bloom_fpp: float = 0.01) -> None:
    """Encodes docs(doc_id, text) into ORC files at path.

    One range shuffle puts documents in order; rows with one doc_id
    spread as well, so no single id makes a large shard.  A shard's file has
    several stripes of about `stripe_bytes`, which are read in parallel and
    skipped by their statistics and Bloom filters.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranged = d.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(common.parts_for(docs.select("doc_id", "text"), shard_bytes), "doc_id", "nth")
    rows = ranged.sortWithinPartitions("doc_id", "nth").select("doc_id", "text").mapInArrow(_encoded(tokenizer, end_id), STORED)
    with common.batches_of(docs.sparkSession, 10_000, BATCH):
        (
            rows.write.option("orc.compress", "LZ4")
            .option("orc.bloom.filter.columns", "doc_id")
            .option("orc.bloom.filter.fpp", str(bloom_fpp))
            .option("orc.row.index.stride", "1000")
            .option("orc.stripe.size", str(stripe_bytes))
            .option("orc.rows.between.memory.checks", "100")
            .orc(path)
        )


def read_tokens(spark: SparkSession, path: str, ids: list[int] | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """Rows of the files; conditions on doc_id reach the ORC reader, which skips stripes by their min/max and Bloom filters."""
    rows = spark.read.schema(STORED).orc(path)
    if ids is not None:
        rows = rows.where(F.col("doc_id").isin(ids))
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.where(F.col("doc_id") <= high)
    return rows


@common.tidy
def _digests(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("pos", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for b in batches:
        ids = b.column("ids")
        at, flat = ids.offsets.to_numpy(), np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")
        crc = [zlib.crc32(flat[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("shard"), b.column("pos"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], schema=schema)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per stored document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Only one total for each shard is gathered in one place; documents need no
    further shuffle, as each carries its position within its shard.
    """
    sums = read_tokens(spark, path).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    each = read_tokens(spark, path).select("doc_id", "shard", "pos", "ids").mapInArrow(_digests, "doc_id long, shard int, pos long, n_tokens long, ids_crc32 long")
    each = common.stored(each, "digests", 250)
    return each.join(before, "shard").select("doc_id", (F.col("before") + F.col("pos")).alias("start"), "n_tokens", "ids_crc32")
