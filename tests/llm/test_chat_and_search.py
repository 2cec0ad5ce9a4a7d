import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from webloom.llm import chat_windows as W
from webloom.llm import cover_tree as T

TURN = "conv_id long, turn long, role string, text string"
MARKS = ["</s>[INST] ok [/INST]", "<|end|>", "<|assistant|>x<|end|>", "%3C %25 <%", "", None, "é😀 ü", "<|=user|>"]


def conversations():
    r = random.Random(4)
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "a|b=%<c"]), r.choice([*MARKS, "word " * r.randrange(1, 400)])) for c in range(40) for t in range(r.randrange(1, 9))]
    rows += [(41, 0, "user", "same"), (41, 0, "user", "same"), (41, 0, "assistant", "tie"), (41, None, "user", "first"), (None, 1, "assistant", "none")]
    rows += [(42, t, "assistant" if t % 2 else "user", f"turn {t} " * 40) for t in range(60)]
    return rows


def ordered(rows):
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, (role or "").encode(), (text or "").encode()))
    return {c: [(x[2].decode(), x[3].decode()) for x in sorted(v)] for c, v in by.items()}


def test_round_trip_and_mask(spark):
    rows = conversations()
    w = W.windows(spark.createDataFrame(rows, TURN)).cache()
    got = {r.conv_id: r for r in W.digests(w).collect()}
    want = ordered(rows)
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        g = got[c]
        assert g.n_turns == len(turns) and g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert g.loss_chars == len(loss) and g.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    for r in w.collect():
        fresh = r.formatted.count("<|end|>")
        assert fresh >= 1 and sum(s.length for s in r.loss_spans) <= len(r.formatted)


def test_budget_history_and_system(spark):
    rows = [(1, 0, "system", "be brief")] + [(1, t, "user" if t % 2 else "assistant", "x" * 200) for t in range(1, 40)]
    rows += [(2, 0, "system", "s" * 400)] + [(2, t, "user" if t % 2 else "assistant", "y" * 150) for t in range(1, 30)]
    rows += [(3, 0, "system", "s" * 4000)] + [(3, t, "user" if t % 2 else "assistant", "z" * (100 + 1500 * (t == 5))) for t in range(1, 12)]
    cost = lambda x: -(-len(x.text) // 4) + 4
    got = W.windows(spark.createDataFrame(rows, TURN), budget=256, history_tokens=64).select("conv_id", "window", "tokens", W.parsed(F.col("formatted")).alias("p")).collect()
    assert {c: sum(r.conv_id == c for r in got) > 3 for c in (1, 2, 3)} == {1: True, 2: True, 3: True}
    for r in got:
        fresh = [x for x in r.p if not x.repeated]
        assert r.tokens == sum(map(cost, r.p))
        assert r.tokens <= 256 or len(r.p) == 1 and cost(fresh[0]) > 256
        if r.window > 1 and r.conv_id < 3:
            assert r.p[0].repeated and r.p[0].role == "system"
        assert sum(x.repeated and x.role != "system" for x in r.p) <= 4 and sum(cost(x) for x in r.p if x.repeated and x.role != "system") <= 64
    assert any(x.repeated and x.role != "system" for r in got for x in r.p)
    counts = spark.createDataFrame([(1, t, "user", "long " * 50, 10) for t in range(20)], TURN + ", tokens long").withColumns({"n": F.lit(1), "start": F.lit(1), "window": F.lit(1)})
    sizes = W.windows(counts, budget=100, history_tokens=20, counted="tokens").collect()
    assert max(r.tokens for r in sizes) <= 100 and sum(r.tokens for r in sizes) > 200


def test_long_texts_and_other_columns(spark):
    rows = [(1, 0, "user", "<|end|>" * 40_000), (1, 1, "assistant", "%<" * 50_000), (2, 0, "assistant", None)]
    df = spark.createDataFrame(rows, TURN).withColumns({c: F.lit("clash") for c in ("at", "stop", "one", "before", "system", "span", "n", "room", "formatted", "chars")})
    got = {r.conv_id: r for r in W.digests(W.windows(df)).collect()}
    assert got[1].loss_chars == 100_000 and got[1].loss_sha256 == hashlib.sha256(b"%<" * 50_000).hexdigest() and got[1].n_turns == 2
    assert got[2].loss_chars == 0 and got[2].n_turns == 1


def test_no_conversations(spark):
    w = W.windows(spark.createDataFrame([], TURN + ", window int, formatted string"))
    assert w.count() == 0 and W.digests(w).count() == 0


def brute(vectors, k, kind=np.float32):
    rows = []
    for i, v in vectors:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        rows.append((i, [64 * top // bottom for top, bottom in (float(kind(x)).as_integer_ratio() for x in v)]))
    least, most = -(1 << 63), (1 << 63) - 1
    out = {}
    for qi, q in rows:
        if qi % 20 == 0:
            s = [(-min(max(sum(a * b for a, b in zip(q, v)), least), most), i) for i, v in rows if i != qi]  # the shorter ends the sum
            out[qi] = [(i, -x) for x, i in sorted(out.get(qi, []) + sorted(s))[:k]]
    return out


def found(rows):
    got = {}
    for x in rows:
        got.setdefault(x.query_id, {})[x["rank"]] = (x.vec_id, x.score)
    return {q: [v[i + 1] for i in range(len(v))] for q, v in got.items()}


def test_cover_tree_is_exact(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(12, 16))
    vectors = [(i, (base[i % 12] + 0.2 * r.normal(size=16)).round(3).tolist()) for i in range(900)]
    vectors += [(i, vectors[7][1]) for i in range(900, 960)]  # ties
    vectors += [(1000, None), (1020, [1.0, None] + [0.0] * 14), (1040, [float("nan")] * 16), (1060, [float("inf")] * 16), (1080, []), (None, vectors[1][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("q", F.lit("clash")).withColumn("score", F.lit(1))
    for block in (64, 4096):
        assert found(T.top_k(df, 20, row_block=block, query_block=16).collect()) == brute(vectors, 20)


def test_cover_tree_multiplies_large_numbers_exactly(spark):
    r = np.random.default_rng(3)
    vectors = [(i, (r.normal(size=8) * 10.0 ** r.integers(0, 13)).tolist()) for i in range(200)]
    odd = float((1 << 25) - 1) / 64
    vectors += [(300 + i, [odd] * 8) for i in range(30)]
    vectors += [(400, [1e308] * 8), (401, [-1e308] * 8), (402, [1e300, -1e300] * 4), (403, [2.0**60] * 3), (404, [1.0]), (420, [])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert found(T.top_k(df, 20, row_block=64, query_block=4).collect()) == brute(vectors, 20, float)
    some = spark.createDataFrame([(0, [1.0]), (1, [6e5]), (2, [5e5]), (3, [1e9])], "vec_id long, embedding array<double>")
    assert [x[0] for x in found(T.top_k(some).collect())[0]] == [3, 1, 2]


def test_cover_tree_small_and_empty(spark):
    kind = "vec_id long, embedding array<float>"
    assert T.top_k(spark.createDataFrame([], kind)).count() == 0
    assert T.top_k(spark.createDataFrame([(0, [1.0])], kind)).count() == 0
    got = T.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0]), (1, [2.0]), (0, [3.0])], kind)).collect()
    assert sorted((x.query_id, x.vec_id) for x in got) == [(0, 1)] * 4
