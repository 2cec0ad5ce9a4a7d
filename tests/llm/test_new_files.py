"""Schema drift, alignment of tokenizers and packing, against brute force."""

import collections
import hashlib
import math
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types

from webloom.llm import alignment, common, drift, packing, queries

SF = "/root/testdata/sf0.001"
tokenizers = pytest.importorskip("public_tokenizers")

ODD = ["", None, " ", "  ", "a", "a  b\n c \n\n d", " x", "x ", "é  y", "▁", "a▁b c", "<|endoftext|> <s></s> <0x41>", "日本語 テキスト 🎉🎉", "\x00a b\x00", "a\t b \tc", "don't  stop", "naïve Ünï ﬁ", "ΑΣ Σ. can't, I'll'", "A.b,C;;", "a<|endoftext|>b,", "word " * 3000, "x" * 4000]


def documents(spark, texts, sources=None):
    rows = [(i, t, (sources or ["a", "b", None])[i % len(sources or "abc")], 7, "w") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, row int, word string").repartition(3)


# ---- packing


def unpacked(rows, window):
    """Checks a packing's rows; the lengths of its sequences."""
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        assert sum(r.length for r in own) <= window
    for own in by_doc.values():
        own.sort(key=lambda r: r.start)
        assert [r.start for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        assert {r.doc_tokens for r in own} == {sum(r.length for r in own)} and min(r.length for r in own) > 0
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return [sum(r.length for r in by_sequence[k]) for k in sorted(by_sequence)]


def test_packing_holds_every_id_once(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    docs = documents(spark, ODD + ["plain words, of some length."] * 30)
    for window, quantum in ((2048, 64), (64, 16), (8, 8)):
        packed = packing.Packing(docs, tokenizers.path("word_bpe_49k.json"), window=window, quantum=quantum)
        rows = packed.pieces(ids=True).collect()
        sizes = unpacked(rows, window)
        assert all(n == window or n & (n - 1) == 0 for n in sizes)  # no padding at all
        for i, text in enumerate(ODD):
            own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
            want = [*library.encode(text or "", add_special_tokens=False).ids, 1]
            assert [x for r in own for x in r.ids] == want
            assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)


def test_windows_hold_target_proportions(spark):
    docs = documents(spark, ["many words stand here " * (3 + i % 40) for i in range(900)], ["a"] * 6 + ["b"] * 3 + [None])
    packed = packing.Packing(docs, tokenizers.path("word_bpe_49k.json"), window=512, quantum=16)
    rows = packed.pieces().collect()
    unpacked(rows, 512)
    share = packed.schedule.tokens / packed.schedule.tokens.sum()
    took = np.zeros((packed.schedule.windows, len(share)))
    for r in rows:
        if r.sequence_id < len(took):
            took[r.sequence_id, r.queue] += r.length
    assert (np.abs(took - 512 * share) <= 3 * 16).all()
    # what one window lacks the next ones make up for
    assert (np.abs(np.cumsum(took, axis=0) - 512 * share * np.arange(1, len(took) + 1)[:, None]) <= 2 * 16).all()


def test_given_weights_until_a_source_ends(spark):
    docs = documents(spark, ["so many words are here"] * 600, ["a", "b"])
    packed = packing.Packing(docs, tokenizers.path("word_bpe_49k.json"), window=64, quantum=8, weights={"a": 3.0, "b": 1.0})
    rows = packed.pieces().collect()
    sizes = unpacked(rows, 64)
    took = collections.Counter()
    for r in rows:
        took[r.sequence_id, r.queue] += r.length
    assert all(abs(took[k, 0] - 48) <= 16 for k in range(len(sizes) // 2))
    assert not any(took[k, 0] for k in range(len(sizes) * 3 // 4, len(sizes)))


def test_schedule_equals_a_walk_of_deficits():
    """The closed form against round-robin one quantum at a time."""
    rng = np.random.default_rng(5)
    for _ in range(30):
        tokens = rng.integers(0, 900, rng.integers(1, 7)).tolist()
        weights = None if rng.random() < 0.5 else rng.uniform(0.2, 5, len(tokens)).tolist()
        s = packing.Schedule(tokens, weights, window=64, quantum=16)
        order = sorted((s.time(q, j), q, j) for q in range(len(tokens)) for j in range(tokens[q] // 16))
        for place, (_, q, j) in enumerate(order):
            assert s.turn(q, np.array([j]))[0] == place
        assert s.full.sum() * 16 == s.windows * 64


def test_many_sources_share_a_queue(spark):
    docs = documents(spark, ["a few words"] * 400, [f"s{i}" for i in range(40)])
    packed = packing.Packing(docs, tokenizers.path("word_bpe_49k.json"), window=64, quantum=8, queues=5)
    unpacked(packed.pieces().collect(), 64)
    assert len(packed.schedule.tokens) == 6


def test_sequences_are_padded_but_at_powers_of_two(spark):
    docs = documents(spark, ["three words here"] * 100)
    rows = packing.Packing(docs, tokenizers.path("word_bpe_49k.json"), window=64, quantum=16).sequences(pad=9).collect()
    assert all(len(r.ids) == (r.n_tokens if r.n_tokens & (r.n_tokens - 1) == 0 else 64) for r in rows)
    assert sum(x.length for r in rows for x in r.segments) == sum(r.n_tokens for r in rows)


def test_packing_of_no_rows(spark):
    assert packing.Packing(documents(spark, ["a"]).where("false"), tokenizers.path("word_bpe_49k.json")).pieces().count() == 0


# ---- alignment


class Plain:
    """Alignment by the definition, token by token."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
        self.signs, self.names = alignment.byte_of(), {i: t for t, i in self.a.get_vocab(True).items()}

    def _spans(self, parts):
        ends = np.cumsum([len(p) for p in parts]).tolist()
        return list(zip([0, *ends[:-1]], ends, strict=True))

    def __call__(self, text):
        none = (0, 0, 0, 0, ""), []
        if not text:
            return none
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        of_a = [bytes(self.signs[c] for c in self.names[i]) for i in a]
        of_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
            return none
        of_a, of_b = self._spans(of_a), self._spans(of_b)
        groups, low = [], 0
        for end in sorted({e for _, e in of_a} & {e for _, e in of_b}):
            groups.append("|".join(",".join(str(i) for i, (_, e) in zip(ids, spans, strict=True) if low < e <= end) for ids, spans in ((a, of_a), (b, of_b))))
            low = end
        links = [(i, j) for i, (s, e) in zip(a, of_a, strict=True) for j, (u, v) in zip(b, of_b, strict=True) if u < e and v > s]
        return (len(a), len(b), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest()), links


@pytest.mark.parametrize("hot", [alignment.HOT, 150, 0])
def test_alignment_equals_brute_force(spark, hot):
    texts = [*ODD[:-2], "word " * 40, *pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()[:25]]
    plain = Plain()
    told = [plain(t) for t in texts]
    count = collections.Counter(x for _, links in told for x in links)
    best = collections.defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    want = sorted((i, *w[:4], sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), w[4]) for i, (w, links) in enumerate(told))
    with common.scratch(spark):
        found = alignment.Alignment(documents(spark, texts), tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model"), hot=hot)
        assert sorted(map(tuple, found.report().collect())) == want
        assert {(r.a_id, r.b_id): r["count"] for r in found.counts().collect()} == count
        assert {r.b_id: r["count"] for r in found.table().collect()} == best


def test_alignment_of_repeats_and_no_rows(spark):
    paths = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, "two words"), (1, "two words"), (None, "two words")], "doc_id long, text string")
    with common.scratch(spark):
        rows = alignment.Alignment(docs, *paths).report().collect()
        assert len(rows) == 3 and len({tuple(r)[1:] for r in rows}) == 1
        assert rows[0].count_sum == 3 * rows[0].n_links
        assert alignment.Alignment(docs.where("false"), *paths).report().count() == 0


# ---- schema drift


def told(rows, n):
    """op11's result by hand."""
    rows = sorted(rows, key=lambda r: (zlib.crc32(str(r["client_id"]).encode()), r["client_id"]))
    each, out = 1 + n // 500, {}
    epoch = np.datetime64(0, "us")
    for f in range(math.ceil(n / each)):
        v = zlib.crc32(f"42:{f}".encode()) % 24
        v = 0 if v > 15 else v
        part = [r | ({"nation_id": -1, "source": "none"} if v & 4 else {}) for r in rows[f * each : (f + 1) * each]]
        names = list(part[0])
        lines = []
        for r in part:
            if v & 8 and r["balance"] is not None:
                r["balance"] = float(np.float32(r["balance"]))
            lines.append("|".join("?" if x is None else str(int((np.datetime64(x, "us") - epoch).astype(int))) if c == "updated_at" else str(math.floor(1048576 * x)) if c == "balance" else str(x) for c, x in r.items()))
        start = [{"name": "email", "email": "name"}.get(c, c) if v & 1 else c for c in names if not (v & 4 and c in ("nation_id", "source"))]
        start = start[:1] + start[:0:-1] if v & 2 else start
        out[f] = (v, len(part), sum(x is None for r in part for x in r.values()), hashlib.sha256(",".join(str(r["client_id"]) for r in part).encode()).hexdigest(), hashlib.sha256("\n".join(lines).encode()).hexdigest(), ",".join(start), ",".join(names), v != 0)
    return out


def test_drift_query_equals_brute_force(spark):
    rows = pq.read_table(f"{SF}/clients.parquet").to_pylist()
    found = queries.op11_drift(spark, SF).collect()
    want = told(rows, len(rows))
    assert {r.file_no: (r.version, r.n_rows, r.n_nulls, r.ids_sha256, r.rows_sha256, r.start_columns, r.columns, r.rewritten) for r in found} == want
    folder = os.path.dirname(found[0].path)
    assert sorted(os.path.basename(r.path) for r in found) == sorted(f for f in os.listdir(folder) if not f.startswith("."))
    schemas = {str(pq.read_schema(r.path).remove_metadata()) for r in found}
    assert len(schemas) == 1 and all(pq.read_schema(found[0].path).field(i).metadata[b"PARQUET:field_id"] == str(i + 1).encode() for i in range(10))


def test_rewrite_of_odd_files_and_again(spark, tmp_path):
    """Nulls against missing, dropped fields, other types; a second run finds nothing to do."""
    schema = drift.with_ids([("a", types.LongType()), ("b", types.StringType()), ("c", types.DoubleType())])

    def field(name, kind, i):
        return pa.field(name, kind, metadata={"PARQUET:field_id": str(i)})

    def write(name, *columns):
        pq.write_table(pa.Table.from_arrays([c[1] for c in columns], schema=pa.schema([c[0] for c in columns])), tmp_path / name)

    write("old.parquet", (field("b", pa.int32(), 1), pa.array([3, None, 1], pa.int32())), (field("gone", pa.string(), 9), pa.array(["x", "y", "z"])))
    write("half.parquet", (field("c", pa.float32(), 3), pa.array([0.1, None], pa.float32())), (field("z", pa.string(), 2), pa.array([None, "t"])), (field("a", pa.int64(), 1), pa.array([5, 5])))
    write("new.parquet", (field("a", pa.int64(), 1), pa.array([7])), (field("b", pa.string(), 2), pa.array(["u"])), (field("c", pa.float64(), 3), pa.array([2.0])))
    before = os.stat(tmp_path / "new.parquet").st_mtime_ns
    with common.scratch(spark):
        missing = {r.path.rsplit("/", 1)[1]: (r.missing, r.drifted) for r in drift.rewrite(spark, str(tmp_path), schema, {"b": "none", "c": -1.5}).collect()}
        assert missing == {"old.parquet": ([2, 3], True), "half.parquet": ([], True), "new.parquet": ([], False)}
        assert pq.read_table(tmp_path / "old.parquet").to_pylist() == [{"a": a, "b": "none", "c": -1.5} for a in (3, None, 1)]
        assert pq.read_table(tmp_path / "half.parquet").to_pylist() == [{"a": 5, "b": None, "c": float(np.float32(0.1))}, {"a": 5, "b": "t", "c": None}]
        assert os.stat(tmp_path / "new.parquet").st_mtime_ns == before
        after = {f: os.stat(tmp_path / f).st_mtime_ns for f in os.listdir(tmp_path)}
        assert not drift.rewrite(spark, str(tmp_path), schema, {}).where("drifted").count()
    assert after == {f: os.stat(tmp_path / f).st_mtime_ns for f in os.listdir(tmp_path)}


def test_drift_of_odd_clients(spark, tmp_path):
    """Null and repeated ids, other columns of clashing names, and a table without rows."""
    clients = spark.read.parquet(f"{SF}/clients.parquet").limit(40)
    odd = clients.unionByName(clients.limit(5)).unionByName(clients.limit(1).withColumn("client_id", F.lit(None).cast("long"))).withColumn("rank", F.lit(1)).withColumn("file_no", F.lit("x"))
    odd.coalesce(1).write.parquet(str(tmp_path / "odd" / "clients.parquet"))
    found = queries.op11_drift(spark, str(tmp_path / "odd")).orderBy("file_no").collect()
    assert [r.n_rows for r in found] == [1] * 46 and found[0].ids_sha256 == hashlib.sha256(b"?").hexdigest()
    clients.where("false").write.parquet(str(tmp_path / "none" / "clients.parquet"))
    assert queries.op11_drift(spark, str(tmp_path / "none")).count() == 0


def test_ranks_are_places_in_a_global_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 4999).alias("x"), F.lit(3).alias("rank0"))
    with common.scratch(spark):
        rows, n = drift.ranked(df, F.col("x"))
        got = [r.x for r in rows.orderBy("rank").collect()]
    assert n == 5000 and got == sorted(got)
