import random
import re
import zlib

import public_tokenizers
from pyspark.sql import functions as F

from webloom.llm import class_lm, decontam, langid, licenses, mixing, token_orc

DOC = "doc_id long, text string, lang string, source string"
ODD = [None, "", " \n\t", "é ü ß", "日本 語", "a" * 5000, "tab\there  two\n\nlines", "<|endoftext|> x <|endoftext|>", "\x1c\x85 x", "'s 're 12 !!"]


def odd_docs(spark, n=60):
    r = random.Random(5)
    words = "the of and to mit license apache general public red blue green".split()
    rows = [(i, r.choice(ODD) if i % 4 == 0 else " ".join(r.choice(words) for _ in range(r.randrange(1, 60))), r.choice(["en", None]), r.choice(["s1", "s2", None])) for i in range(n)]
    rows += [rows[3], rows[3], (None, "the null id", "en", "s1")]
    return rows, spark.createDataFrame(rows, DOC)


def test_tokens_equal_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    rows, df = odd_docs(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    out = str(tmp_path / "tokens")
    token_orc.write_tokens(df.withColumn("ids", F.lit(1)).withColumn("shard", F.lit(2)), out, path, shard_bytes=2000)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_orc.token_digests(spark, out).collect()]
    start, want = 0, []
    for i, x in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(b"".join(v.to_bytes(4, "little") for v in ids))))
        start += len(ids)
    key = lambda r: r[1]
    assert sorted(got, key=key) == want
    assert {r.doc_id for r in token_orc.read_tokens(spark, out, ids=[3, 5]).collect()} == {3, 5}
    assert token_orc.read_tokens(spark, out, low=10, high=12).count() == 3


def test_readers_skip_stripes(spark, tmp_path):
    from pyarrow import orc

    r = random.Random(6)
    df = spark.createDataFrame([(3 * i, " ".join(str(r.random()) for _ in range(30))) for i in range(6000)], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "docs"))
    out = tmp_path / "tokens"
    token_orc.write_tokens(spark.read.parquet(str(tmp_path / "docs")), str(out), public_tokenizers.path("byte_bpe_50k.json"), shard_bytes=1 << 30, stripe_bytes=256 << 10)
    (file,) = out.glob("*.orc")
    footer = orc.ORCFile(str(file))
    assert footer.nstripes >= 4 and footer.nrows == 6000
    assert b"\x00" in file.read_bytes() and footer.read(columns=["doc_id"])["doc_id"].to_pylist() == list(range(0, 18000, 3))

    def read(**asked):
        rows = token_orc.read_tokens(spark, str(out), **asked).select("doc_id")
        found = [x.doc_id for x in rows.collect()]
        plan = rows._jdf.queryExecution().executedPlan()
        return found, plan.collectLeaves().head().metrics().get("numOutputRows").get().value()

    found, rows = read(ids=[9000])
    assert found == [9000] and rows <= 1000  # one row group
    assert read(ids=[9001]) == ([], 0)  # between the least and the largest: only the Bloom filter can tell
    found, rows = read(low=17000)
    assert len(found) == 333 and rows <= 1000


def test_encoder_cuts_nowhere_else():
    r = random.Random(1)
    e = token_orc.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert e.by_word
    bits = ["a", "B", "foo", " ", "  ", "\n", "\t", "\n ", ".", "'s", " 're", "é", "日本", "\x1c", "\x85", "<|endoftext|>", "12", "!!", "\r\n", "_", "🙂", "Ġ", "word,", "x.!?", "don't,", "€.", "'", "Ünö%%%", "7$", "\u0301.", "ª,", "(a)."]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(30))) for _ in range(4000)]
    flat, n = e.encode(texts)
    want = e._ids(texts)
    assert flat.tolist() == [i for x in want for i in x.tolist()] and n.tolist() == [len(x) for x in want]
    assert e.encode([])[0].size == 0
    assert not token_orc.Encoder(public_tokenizers.path("word_bpe_49k.json")).by_word


def test_no_documents(spark, tmp_path):
    df = spark.createDataFrame([], DOC)
    out = str(tmp_path / "none")
    token_orc.write_tokens(df, out, public_tokenizers.path("byte_bpe_50k.json"))
    assert token_orc.token_digests(spark, out).count() == 0
    assert class_lm.score(df, F.lit(True)).count() == 0
    assert langid.predict(df.select(F.col("doc_id").alias("row"), "text"), langid.fit(df, F.lit(True))).count() == 0
    assert licenses.scan(df.select(F.col("doc_id").alias("row"), "text")).count() == 0
    assert mixing.mixed(df).count() == 0
    assert decontam.report(df, spark.createDataFrame([], "item_id long, text string")).count() == 0


def lm_tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)})), None]


def test_language_model(spark):
    import math
    from collections import Counter

    rows, df = odd_docs(spark, 150)
    held = langid.held_out(F.col("doc_id"), 7, 2)
    got = class_lm.score(df.withColumn("n", F.lit(1)).withColumn("word", F.lit("clash")), F.col("doc_id").isNotNull() & ~held, head=6, items=4, bundles=8, classes=3).collect()
    c = Counter()
    for i, t, *_ in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(lm_tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if i is None else i, len(lm_tokens(t)), sum(c[w] > 0 for w in lm_tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in lm_tokens(t)), 6)) for i, t, *_ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score <= 1e-9 for r in got) and sum(r.score for r in got) > sum(r.base_score for r in got)


def test_model_is_a_distribution():
    """Over the end, all seen words and one unseen word of each bundle, probabilities after any class sum up to one."""
    import numpy as np
    import pyarrow as pa

    counts = {class_lm.END: 9, b"a": 8, b"b": 7, b"cc": 3, b"dd": 2, b"ee": 2, b"ff": 1}
    head = pa.table({"word": list(counts), "n": list(counts.values())})
    m = class_lm.Model(head, sum(counts.values()), len(counts), items=3, bundles=4)
    tails, types = np.zeros(4), np.zeros(4)
    for w in (b"cc", b"dd", b"ee", b"ff"):
        tails[class_lm.bundle_of(w, 4)] += counts[w]
        types[class_lm.bundle_of(w, 4)] += 1
    pairs = np.arange(49)
    m.finish(pairs, np.arange(49) % 5 + 1, tails, types, 0.5, classes=2)
    items = [*range(3), *[m.items + b for b in range(4)]]
    for c in range(3):
        assert abs(sum(10 ** (m.step[c, m.of[i]] + m.emit[i]) for i in items) - 1) < 1e-9
    for b in range(4):
        inside = sum(10 ** m.within[i] for i, w in enumerate(m.words) if m.item[i] == m.items + b)
        assert abs(inside + 10 ** (m.unseen[b] - m.in_bundle[b]) - 1) < 1e-9


def test_exchange_finds_classes():
    import numpy as np

    r = np.random.default_rng(0)
    line = [0]
    for _ in range(4000):  # words 1-4 and 5-8 alternate
        line.append(int(r.integers(1, 5) if line[-1] == 0 or line[-1] > 4 else r.integers(5, 9)))
    x = np.array(line)
    codes, counts = np.unique(x[:-1] * 9 + x[1:], return_counts=True)
    of = class_lm.exchange(9, 0, codes, counts, 2)
    assert len({*of[1:5]}) == 1 and len({*of[5:]}) == 1 and of[1] != of[5] and of[0] == 2


def test_words_are_placed_where_the_likelihood_is_best():
    import numpy as np

    r = np.random.default_rng(3)
    k, classes = 6, 5
    table, words = r.integers(0, 400, (k, k)).astype(float), []
    for i in range(300):
        after, before = r.poisson(0.4, k) * r.integers(1, 4), r.poisson(0.4, k)
        words.append((after, before, int(i % 5 == 0)))
    after, before, own = (np.array(x) for x in zip(*words, strict=True))
    got = class_lm.best_classes(table, after.astype(float), before.astype(float), own.astype(float), classes)

    def likelihood(t):
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return f(t) - f(t.sum(0)) - f(t.sum(1))

    for x, y, o, c in zip(after, before, own, got, strict=True):
        by_class = []
        for b in range(classes):
            t = table.copy()
            t[b] += x
            t[:, b] += y
            t[b, b] += o
            by_class.append(likelihood(t))
        assert by_class[c] >= max(by_class) - 1e-6


def test_rare_words_have_classes_of_their_own_bigrams(spark):
    """Rare words of one bundle, some used like the item `p`, some like `q`: texts tell them apart by single words."""
    r = random.Random(8)
    rows = []
    for i in range(400):
        a, b = ("x", "p") if i % 2 else ("y", "q")
        rows.append((i, " ".join(f"{a} {b if r.random() < 0.7 else f'{b}{r.randrange(40):03d}end'}" for _ in range(20))))
    right = ["x p%03dend x" % i for i in range(40)]
    wrong = ["x q%03dend x" % i for i in range(40)]
    rows += [(1000 + i, t) for i, t in enumerate(right + wrong)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for head in (6, 1000):  # rare words outside and in the head
        got = {x.doc_id: x.score for x in class_lm.score(df, F.col("doc_id") < 1000, head=head, items=5, bundles=4, classes=4).collect()}
        assert len(got) == len(rows)
        assert sum(got[1000 + i] - got[1040 + i] for i in range(40)) > 40 * 0.3


def test_language_identification(spark):
    r = random.Random(6)
    vocabulary = {"en": "the and thing with hello would that", "de": "der und nicht ein über schön straße", "fr": "le et être français très où ça", "es": "el y niño español qué más año"}
    rows = [(i, " ".join(r.choice(vocabulary[v].split()) for _ in range(12)), v, "s") for i in range(400) for v in [r.choice(list(vocabulary))]]
    rows += [(1000, None, "en", None), (1001, "", None, None), (1002, "123 !?", "fr", None), (None, "the thing", "en", None)]
    df = spark.createDataFrame(rows, DOC)
    held = langid.held_out(F.col("doc_id"), 4, 2)
    model = langid.fit(df, F.col("doc_id").isNotNull() & ~held, sample=128)
    got = {x.row: x for x in langid.predict(df.select(F.col("doc_id").alias("row"), "text", F.lit(0.0).alias("score")), model).collect()}
    test = [(i, v) for i, _, v, _ in rows if i is not None and i < 1000 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(test) > 50 and all(got[i].lang_pred == v for i, v in test)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert got[None].lang_pred == "en" and all(0 <= x.score <= 1 for x in got.values())
    assert {x.lang_pred for x in langid.predict(df.select(F.col("doc_id").alias("row"), "text"), None).collect()} == {"und"}


def test_licenses(spark):
    texts = ["Released under the MIT License.", "releasd under the mit licnse", "ALL-RIGHTS reservd", "the mit-license, mit license mit license", None, "", "permitted licenses", "Licensed under the Apache License, Version 2.0 and General Public License", "é mit license"]
    df = spark.createDataFrame(list(enumerate(texts)), "row int, text string")
    got = {r.row: r for r in licenses.scan(df.withColumn("labels", F.lit("clash"))).collect()}
    g = got[0]
    assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels, g.labels, g.score) == (5, 1, 3, 3, "mit", "mit", 1.0)
    assert got[1].base_labels == "" and got[1].labels == "mit" and 0.8 < got[1].score < 1 and got[1].spans[0].label == "mit"
    assert got[2].labels == "all-rights-reserved" and got[3].n_base == 3 and (got[3].first_word, got[3].last_word) == (1, 5)
    assert (got[4].n_words, got[4].n_base, got[4].first_word, got[4].labels, got[4].score) == (0, 0, None, "", 0.0)
    assert got[6].labels == "" and got[7].base_labels == "apache,gpl" and got[8].first_word == 1


def test_fuzzy_notices_equal_a_scan_of_everything():
    import regex

    r = random.Random(8)
    s = licenses.Searcher()
    for notice, label in licenses.NOTICES.items():
        k = min(licenses.MOST_ERRORS, max(1, len(notice) // licenses.PER_ERROR))
        for errors in [*range(k + 3)] * 6:
            t = list(notice)
            for at in sorted(r.sample(range(1, len(t) - 1), min(errors, len(t) - 2)), reverse=True):
                t[at : at + 1] = r.choice([["q"], ["z"], ["x"], [], [t[at], "q"]])  # another character, none, one more
            text = "aa bb " + "".join(t) + " cc"
            want = bool(regex.search(f"(?:{regex.escape(notice)}){{e<={k}}}", text))
            assert (label in {x[2] for x in s.fuzzy(text)}) >= want


def contained(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    w, hit, ids = words(text), set(), set()
    for i, t in items:
        x = words(t)
        n = min(10, len(x))
        for s in range(len(x) - n + 1 if x else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == x[s : s + n]:
                    hit.update(range(p, p + n))
                    if i is not None:
                        ids.add(str(i))
    return len(w), len(hit), ",".join(sorted(ids))


def test_decontamination(spark):
    import hashlib

    r = random.Random(9)
    words = "a b c d e f g H é 7".split()
    items = [(i, " ".join(r.choice(words) for _ in range(n))) for i, n in enumerate([1, 2, 3, 9, 10, 11, 14, 25, 2])]
    items += [(5, items[7][1]), (None, "zz yy"), (77, None), (78, "!?"), (79, "a")]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 50)))) for i in range(60)]
    docs += [(100, "x " + items[7][1].upper() + " y"), (101, None), (102, "zz, yy"), (103, "a"), (103, "a"), (103, "b c"), (None, items[6][1]), (104, "a " * 30), (105, items[6][1][:-1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(5)).withColumn("w", F.lit(1)).withColumn("window", F.lit(1))
    it = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    want = sorted((-1 if i is None else i, *contained(t, items)) for i, t in docs)
    want = sorted((i, n, h, len(x.split(",")) if x else 0, hashlib.sha256(x.encode()).hexdigest(), h > 0) for i, n, h, x in want)
    for block in (decontam.BLOCK, 7):  # with 7, the documents are read for many blocks of shingles
        got = decontam.report(df, it, block=block).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    clash = df.withColumns({c: F.lit(1) for c in ("_d", "_h", "d", "h", "k", "row", "pos", "near")})
    named = it.withColumn("item_id", F.concat(F.lit("i"), F.col("item_id").cast("string")))
    assert sum(r.contaminated for r in decontam.report(clash, named).collect()) == sum(x[5] for x in want)
    assert decontam.clean(clash, named).columns == clash.columns and decontam.clean(clash, named).count() == sum(not x[5] for x in want)
    left = decontam.clean(df, it)
    assert left.columns == df.columns and sorted(-1 if r.doc_id is None else r.doc_id for r in left.collect()) == sorted(x[0] for x in want if not x[5])
    plain = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontam.report(df, plain).collect())


def test_mixing(spark):
    r = random.Random(10)
    rows = [(i, "w " * r.randrange(0, 40), "en", s) for i, s in enumerate(r.choices(["a", "b", "c", "d", None], [60, 10, 10, 2, 1], k=3000))]
    rows += [rows[5], rows[5], (None, "x y", "en", "a"), (9001, None, "en", None)]
    df = spark.createDataFrame(rows, DOC).withColumn("key", F.lit("clash")).withColumn("size", F.lit(-1))
    m = mixing.measured(df)
    goal = {x.source: x for x in mixing.plan(m).collect()}
    total = sum(len((t or "").split()) for _, t, _, _ in rows)
    weights = dict(zip(["a", "b", "c", "d", None], [3, 1, 2, 3, 1], strict=True))
    size = {s: sum(len((t or "").split()) for _, t, _, x in rows if x == s) for s in weights}
    left, open_, want = 1.5 * total, set(weights), {}
    while True:
        w = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / w > 2 * size[s]]
        if not over:
            want |= {s: left * weights[s] / w for s in open_}
            break
        for s in over:
            want[s] = 2.0 * size[s]
        left -= sum(2.0 * size[s] for s in over)
        open_ -= set(over)
    assert all(abs(goal[s].target - want[s]) < 1e-6 and goal[s].source_size == size[s] for s in weights)
    taken = mixing.copies(m, mixing.plan(m)).collect()
    assert len(taken) == len(rows) and max(x.copies for x in taken) <= 2
    for s in weights:
        got = sum(x.copies * x.size for x in taken if x.source == s)
        assert abs(got - want[s]) <= 3 * 40
    # weights tell which documents the fraction of an epoch is made of
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(3000)] + [(7, 0), (None, 1)], "doc_id long, quality int")
    half = mixing.measured(mixing.judged(df, labels), F.col("weight"))
    some = mixing.copies(half, mixing.plan(half, share=0.5)).where("size > 0 and doc_id < 3000").groupBy((F.col("doc_id") % 2).alias("good")).agg(F.avg("copies").alias("n")).collect()
    n = {r.good: r.n for r in some}
    assert n[1] > 2 * n[0] > 0
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns and mixed.count() == sum(x.copies for x in taken)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mixed(df).collect()))


def test_score_equals_brute_force(spark, monkeypatch):
    """The score from the classes that training chose, token by token; transitions and masses are counted anew."""
    import math
    from collections import Counter

    seen = {}
    place, stored, stepped = class_lm.Model.place, class_lm.common.stored, class_lm._stepped

    def placing(self, words, per):
        place(self, words, per)
        seen["model"] = self

    def storing(df, name, *args, **kinds):
        out = stored(df, name, *args, **kinds)
        if name == "placed":
            seen["placed"] = {bytes(r.word): (r.n, r["class"]) for r in out.collect()}
        return out

    def stepping(step):
        seen["step"] = step
        return stepped(step)

    monkeypatch.setattr(class_lm.Model, "place", placing)
    monkeypatch.setattr(class_lm.common, "stored", storing)
    monkeypatch.setattr(class_lm, "_stepped", stepping)
    rows, df = odd_docs(spark, 150)
    learned = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2
    classes = 3
    got = class_lm.score(df, F.col("doc_id").isNotNull() & ~langid.held_out(F.col("doc_id"), 7, 2), head=8, items=4, bundles=8, classes=classes).collect()
    m, placed, step = seen["model"], seen["placed"], seen["step"]
    assert all(c == m.of[m.items + class_lm.bundle_of(w, m.bundles)] for w, (n, c) in placed.items() if n == 1)
    tokens = lambda t: [class_lm.END if w is None else w.encode() for w in lm_tokens(t)]
    items = {w: i for i, w in enumerate(m.words[: m.items])}
    counts = Counter(w for i, t, *_ in rows if learned(i) for w in tokens(t))
    assert {w: n for w, (n, _) in placed.items()} == {w: n for w, n in counts.items() if w not in items}
    of = lambda w: int(m.of[items[w]]) if w in items else placed[w][1] if w in placed else int(m.of[m.items + class_lm.bundle_of(w, m.bundles)])
    mass, pairs = Counter(), Counter()
    for w, n in counts.items():
        mass[of(w)] += n
    for i, t, *_ in rows:
        if learned(i):
            line = [classes, *(of(w) for w in tokens(t))]
            pairs.update(zip(line, line[1:], strict=False))
    total = {b: sum(n for (_, y), n in pairs.items() if y == b) + 0.5 for b in range(classes + 1)}
    for a in range(classes + 1):
        after = sum(n for (x, _), n in pairs.items() if x == a)
        for b in range(classes + 1):
            want = (pairs[a, b] + class_lm.STRENGTH * total[b] / sum(total.values())) / (after + class_lm.STRENGTH)
            assert abs(step[a, b] - math.log10(want)) < 1e-9

    def score(t):
        at, sum_ = classes, 0.0
        for w in tokens(t):
            c, n = of(w), counts[w]
            sum_ += step[at, c] + (math.log10((n - m.off[c]) / mass[c]) if n else m.unplaced[class_lm.bundle_of(w, m.bundles)])
            at = c
        return sum_

    want = sorted((-1 if i is None else i, round(score(t), 6)) for i, t, *_ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, round(r.score, 6)) for r in got) == want


def test_mix_of_small_weights_keeps_its_target(spark):
    """Weights that made all keys of a power 0: taken words come within a document of the target."""
    df = spark.createDataFrame([(i, "s", "five words are in here", None, 1, 2) for i in range(1000)], "doc_id long, source string, text string, w double, d int, q int")
    for w in (F.col("w"), F.lit(0.001), F.lit(0.005)):
        d = mixing.measured(df, w)
        assert d.select("key").distinct().count() == 1000
        taken = mixing.copies(d, mixing.plan(d)).agg(F.sum(F.col("copies") * F.col("size"))).first()[0]
        assert abs(taken - 7500) <= 5
    # columns that the join uses as names stay
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    judged = mixing.judged(df, labels)
    assert judged.columns == [*df.columns, "weight"] and judged.where("d = 1 and q = 2").count() == 1000
