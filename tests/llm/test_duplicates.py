import hashlib
import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from webloom.llm import jaccard, repeats

DOC = "doc_id long, text string"


def shingles(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_components(docs):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted((-1 if d is None else d, len(sets[i]), -1 if (c := (least.get(root(i)) if sets[i] else d)) is None else c) for i, (d, _) in enumerate(docs))


def near_copies(seed=11):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([3, 5, 30, 120])))) for i in range(60)]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    for base in range(6):  # families of copies with few and with many edits, and copies of copies
        w = [r.choice(vocabulary) for _ in range(r.choice([60, 150, 300]))]
        family = [w]
        for k in range(60):
            c = list(r.choice(family))
            for _ in range(r.randrange(0, max(2, len(c) // 25))):
                c[r.randrange(len(c))] = r.choice(vocabulary[:20] if base % 2 else vocabulary)
            if k % 7 == 0:
                del c[r.randrange(len(c))]
            family.append(c)
        docs += [(1000 * (base + 1) + i, " ".join(c)) for i, c in enumerate(family)]
    docs += [(8000 + i, passage + " " + " ".join(r.choice(vocabulary) for _ in range(r.randrange(5, 80)))) for i in range(60)]
    docs += [(9000, None), (9001, ""), (9002, " \n"), (9003, "A b"), (9004, "a B"), (9005, "x " * 500), (9006, "X " * 900), (9007, docs[70][1]), (9007, docs[70][1]), (None, docs[80][1]), (None, "only null")]
    r.shuffle(docs)
    return docs


def test_components_equal_brute_force(spark):
    for seed in (11, 12):
        docs = near_copies(seed)
        df = spark.createDataFrame(docs, DOC).withColumn("set", F.lit("clash")).withColumn("size", F.lit(1))
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in jaccard.Join(df).result().collect())
        assert got == brute_components(docs)


def test_one_of_each(spark):
    docs = near_copies()
    df = spark.createDataFrame(docs, DOC).withColumn("k", F.lit("clash")).withColumn("row", F.lit(1))
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    parts = brute_components([x for x in docs if x[0] is not None])
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted({c for d, n, c in parts if n} | {d for d, n, _ in parts if not n})
    unique = spark.createDataFrame([(1, "a b c d e"), (2, "A b c d e"), (3, "z")], DOC)
    assert sorted(r.doc_id for r in jaccard.one_of_each(unique).collect()) == [1, 3]


def test_no_documents(spark):
    df = spark.createDataFrame([], DOC)
    assert jaccard.Join(df).result().count() == 0 and jaccard.one_of_each(df).count() == 0
    assert repeats.Repeats(df).removed().count() == 0


def brute_repeats(docs, size):
    texts = [(d, (t or "").encode()) for d, t in docs]
    seen = {}
    for _, b in texts:
        for i in range(len(b) - size + 1):
            seen[b[i : i + size]] = seen.get(b[i : i + size], 0) + 1
    out = []
    for d, b in texts:
        cut = [False] * len(b)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                cut[i : i + size] = [True] * size
        runs = sum(c and not (i and cut[i - 1]) for i, c in enumerate(cut))
        out.append((-1 if d is None else d, len(b), sum(cut), runs, hashlib.sha256(bytes(x for x, c in zip(b, cut) if not c)).hexdigest()))
    return sorted(out)


def texts_with_repeats(seed=13):
    r = random.Random(seed)
    letters = "abcdefgh é日"
    random_text = lambda n: "".join(r.choice(letters) for _ in range(n))
    passages = [random_text(n) for n in (150, 199, 200, 201, 260, 700)]
    docs = [(i, random_text(r.randrange(0, 500))) for i in range(30)]
    docs += [(100 + i, random_text(r.randrange(80)) + r.choice(passages) + random_text(r.randrange(80)) + r.choice(["", r.choice(passages)])) for i in range(60)]
    long_ = random_text(2500)
    for i in range(8):
        c = list(long_)
        for _ in range(i):
            c[r.randrange(len(c))] = r.choice(letters)
        docs.append((300 + i, "".join(c)))
    docs += [(400, None), (401, ""), (402, "ab " * 400), (403, "x" * 1000), (404, "x" * 199), (405, "y" * 200), (406, docs[95][1]), (406, docs[95][1]), (None, passages[4]), (None, passages[5])]
    return docs


def test_removed_bytes_equal_brute_force(spark, monkeypatch):
    for most in (repeats.MOST, 3):  # with 3, most grams are compared by single windows
        monkeypatch.setattr(repeats, "MOST", most)
        docs = texts_with_repeats()
        df = spark.createDataFrame(docs, DOC).withColumn("body", F.lit("clash")).withColumn("spans", F.lit(0))
        got = repeats.Repeats(df).removed().collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(docs, 200)


def test_joined_repeats_are_maximal_with_all_occurrences(spark, monkeypatch):
    r = random.Random(15)
    letters = "abcdefgh"
    text = lambda n: "".join(r.choice(letters) for _ in range(n))
    long_, tail = text(1200), text(300)
    docs = [(1, "X" + long_ + "p" + text(30)), (2, text(50) + "Y" + long_ + tail + "q"), (3, "Z" * 3 + long_ + tail + "r" + text(400)), (4, text(900))]
    docs += [(5, docs[3][1]), (6, None), (7, "x" * 150), (8, text(60) + tail + text(20)), (9, text(260) + long_[300:700] + text(90)), (10, "k" + docs[3][1][100:600])]
    bytes_of = {d: (t or "").encode() for d, t in docs}
    places = lambda x: sorted((d, i) for d, b in bytes_of.items() for i in range(len(b) - len(x) + 1) if b[i : i + len(x)] == x)
    for most, reach in ((repeats.MOST, 1024), (1, 16)):  # with 1, all grams are compared by single windows
        monkeypatch.setattr(repeats, "MOST", most)
        df = spark.createDataFrame(docs, DOC)
        keys = {}
        for x in df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect():
            keys.setdefault(x.h, []).append(x.doc_id)
        found = {}
        for x in repeats.Repeats(df).maximal(reach).collect():
            assert x.copies == len(keys[x.text_hash])
            b = bytes_of[keys[x.text_hash][0]][x.place : x.place + x.length]
            assert len(b) == x.length >= 200
            found.setdefault(x.repeat, (b, x.n, []))[2].extend((d, x.place) for d in keys[x.text_hash])
        assert len({b for b, _, _ in found.values()}) == len(found)  # none twice
        for b, n, at in found.values():
            assert sorted(at) == places(b) and n == len(at) > 1
            for side in (lambda d, i, b=b: bytes_of[d][i - 1 : i] if i else d, lambda d, i, b=b: bytes_of[d][i + len(b) : i + len(b) + 1] or d):
                assert len({side(d, i) for d, i in at}) > 1
        strings = {b: at for b, _, at in found.values()}
        assert len(strings[long_.encode()]) == 3 and len(strings[(long_ + tail).encode()]) == 2
        # each window that repeats has a repeat that occurs as often
        whole = [set(places(b)) for b in strings]
        for d, b in bytes_of.items():
            for i in range(len(b) - 199):
                w = places(b[i : i + 200])
                if len(w) > 1:
                    assert any({(e, j + k) for e, j in at} == set(w) for x, at in strings.items() for k in [x.find(b[i : i + 200])] if k >= 0)
        assert whole


def test_maximal_repeats():
    r = random.Random(14)
    size = 20
    core = bytes(r.randrange(97, 100) for _ in range(60))
    contexts = [bytes([65 + i]) * 3 + core[i % 3 * 5 :][: 40 + i] + bytes([75 + i]) for i in range(6)]
    counts = [max(0, len(c) - size + 1) for c in contexts]
    groups = repeats.occurrences_of(repeats.maximal_repeats(contexts, counts, size))
    assert groups
    for length, members in groups:
        strings = {contexts[i][p : p + length] for i, p in members}
        assert len(members) > 1 and len(strings) == 1 and length >= size
        (s,) = strings
        every = [(i, p) for i, c in enumerate(contexts) for p in range(counts[i]) if c[p : p + length] == s]
        assert sorted(members) == every  # all occurrences
        assert len({contexts[i][p - 1 : p] if p else (i,) for i, p in members}) > 1
        assert len({contexts[i][p + length : p + length + 1] or (i,) for i, p in members}) > 1
    covered = {(i, p + k) for n, m in groups for i, p in m for k in range(n)}
    want = set()
    for i, c in enumerate(contexts):
        for p in range(counts[i]):
            if sum(c[p : p + size] == d[q : q + size] for j, d in enumerate(contexts) for q in range(counts[j])) > 1:
                want |= {(i, p + k) for k in range(size)}
    assert covered == want


def written(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def test_pipeline(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    frame, kept = docs, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / f"s{len(kept)}")
        stage(spark, frame, sf).write.parquet(path)
        frame = spark.read.parquet(path)
        assert frame.columns == docs.columns
        kept.append(frame.count())
    last = corpus_pipeline.STAGES[-1][1](spark, frame, sf)
    assert last.count() == kept[-1]
    run = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, run.collect())) == sorted(map(str, last.collect()))
    assert kept[0] > kept[2] and [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "mixing sources", "token-ID output"]


def kept_by_brute_force(docs, n, percent):
    """Ids of the documents without words and of the smallest of each linked group."""
    sets = {d: shingles(t, n) for d, t in docs}
    group = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            x, y = sets[a], sets[b]
            if a < b and group[a] != group[b] and x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    return sorted(d for d, g in group.items() if d == g)


def test_pipeline_drops_near_duplicates_of_five_words(spark):
    words = [f"v{i}" for i in range(1000)]
    docs = [(i, t) for i, (_, t) in enumerate(near_copies())]
    docs += [(9500, " ".join(words[:200])), (9501, " ".join(words[:245]))]  # 196 of 241 shingles: 0.813; 0.814 on four words
    docs += [(9502, " ".join(words[300:500])), (9503, " ".join(words[300:550]))]  # 196 of 246: 0.797
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(docs, DOC), "").collect())
    assert kept == kept_by_brute_force(docs, 5, 80)
    assert {9500, 9501, 9502, 9503} & set(kept) == {9500, 9502, 9503}


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    """Kept ids of the duplicate and benchmark stages, words by source of the mix, tokens of the output; languages have a test of their own."""
    import zlib

    import public_tokenizers
    from test_text_operators import contained
    from tokenizers import Tokenizer

    r = random.Random(21)
    vocabulary = [f"u{i}" for i in range(400)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([3, 10, 12, 30])]
    docs = [(i, text(r.randrange(20, 60)), r.choice("aaab")) for i in range(80)]
    docs += [(100 + i, docs[i][1] + " " + text(i), "a") for i in range(25)]  # near copies, from equal to unlike
    docs += [(200 + i, text(9) + ", " + t[: len(t) - i % 2] + " " + text(9), "b") for i, (_, t) in enumerate(items * 2)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.createDataFrame([(d, t, "en", s) for d, t, s in docs], "doc_id long, text string, lang string, source string")
    of = {d: (t, s) for d, t, s in docs}

    unlike = written(corpus_pipeline.near_duplicates(spark, df, str(tmp_path)), tmp_path / "unlike")
    want = kept_by_brute_force([(d, t) for d, t, _ in docs], 5, 80)
    assert sorted(x.doc_id for x in unlike.collect()) == want and len(want) < len(docs)

    clean = written(corpus_pipeline.decontaminated(spark, unlike, str(tmp_path)), tmp_path / "clean")
    left = [d for d in want if not contained(of[d][0], items)[1]]
    assert sorted(x.doc_id for x in clean.collect()) == left and len(left) < len(want)

    mix = written(corpus_pipeline.mixture(spark, clean, str(tmp_path)), tmp_path / "mix")
    size = {s: sum(len(of[d][0].split()) for d in left if of[d][1] == s) for s in "ab"}
    goal = {s: 1.5 * sum(size.values()) * w / 4 for s, w in (("a", 3), ("b", 1))}  # weights 3 and 1, two epochs at most
    for s, other in ("ab", "ba"):
        if goal[s] > 2 * size[s]:
            goal = {s: 2 * size[s], other: min(2 * size[other], 1.5 * sum(size.values()) - 2 * size[s])}
    taken = [x.doc_id for x in mix.collect()]
    assert set(taken) <= set(left)
    for s in "ab":
        assert abs(sum(len(of[d][0].split()) for d in taken if of[d][1] == s) - goal[s]) <= 3 * 85

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: [*t.encode(of[d][0], add_special_tokens=False).ids, 2] for d in set(taken)}
    out = corpus_pipeline.tokens(spark, mix, str(tmp_path)).collect()
    crc = lambda x: zlib.crc32(b"".join(v.to_bytes(4, "little") for v in x))
    assert sorted((x.doc_id, x.n_tokens, x.ids_crc32) for x in out) == sorted((d, len(ids[d]), crc(ids[d])) for d in taken)


def test_shingles_of_like_polynomials_differ(spark):
    """Words whose polynomials are equal modulo 2**64 for every odd base are no link."""
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, f"{one} w1 w2 w3"), (2, f"{other} w1 w2 w3"), (3, f"{one} w1 w2 w3")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.Join(docs).result().collect()}
    assert got == {1: 1, 2: 2, 3: 1}
