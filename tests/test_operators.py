import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from webloom.operators import crawl as C
from webloom.operators import memory as M
from webloom.operators import relevance as R
from webloom.operators import research as D
from webloom.operators import search as S
from webloom.operators import state as ST
from webloom.plans import api
from webloom.sources import proxies
from webloom.streaming import events as EV

RESULT = "ord long, engine string, url string, title string, content string, published_at string, domain string, source_type string, breadcrumbs array<string>"


def results(spark):
    return spark.createDataFrame(
        [
            (1, "a", "https://x.org/p?utm_s=1", "", "first content", None, "x.org", None, ["x.org", "Docs"]),
            (2, "b", "https://x.org/p", "Title", "other", "2024-01-20", None, "docs", ["x.org", "docs", "p"]),
            (3, "b", "https://y.org/q", "Rust guide", "rust programming", None, "y.org", "other", ["y.org"]),
            (4, "b", "https://y.org/r", "rust GUIDE", "Rust   programming", None, "y.org", "other", ["y.org"]),
        ],
        RESULT,
    )


def test_merged(spark):
    got = {r.url_key: r for r in S.merged(results(spark)).collect()}
    x = got["https://x.org/p"]
    assert (x.title, x.content, x.published_at, x.domain, x.source_type, x.engine) == ("Title", "first content", "2024-01-20", "x.org", "docs", "multi:a,b")
    assert x.breadcrumbs == ["x.org", "Docs", "p"] and x.url.endswith("utm_s=1") and len(got) == 3


def test_web_search(spark):
    got = api.web_search(results(spark), "rust programming", F.lit(dt.date(2024, 2, 1))).collect()
    assert [r.url_key for r in got] == ["https://y.org/q", "https://x.org/p"]  # the other y.org result has the same signature
    x = got[1]
    assert x.score == pytest.approx(1.35 * 1.2 + 0.35 + 0.25)


def test_empty_results(spark):
    assert api.web_search(spark.createDataFrame([], RESULT), "q", F.lit(dt.date(2024, 2, 1))).count() == 0


def test_duplicates_removed(spark):
    r = S.duplicates_removed(results(spark)).first()
    assert (r.total, r.kept, r.removed) == (4, 3, 1)


def test_shaved(spark):
    long_ = "alpha beta gamma " * 100 + "delta epsilon zeta " * 100
    got = {r.id: r for r in R.shaved(spark.createDataFrame([(1, long_), (2, "short text"), (3, None), (4, "")], "id long, text string"), "delta epsilon zeta", 0.9).collect()}
    assert len(got[1].text) < len(long_) and "delta" in got[1].text and got[1].kept < got[1].total
    assert got[2].text == "short text" and got[3].text is None and got[4].text == ""


def test_section_extract(spark):
    md = "# Intro\n" + "plain words here " * 60 + "\n# Quantization\n" + "about quantization of weights " * 20 + "\n# Other\n" + "more filler text " * 30
    df = spark.createDataFrame([(1, md), (2, "few words")], "id long, text string")
    got = {r.id: r for r in R.section_extract(df, "quantization").collect()}
    assert "quantization" in got[1].text and len(got[1].text) < len(md) and got[1].note == "section_extract" and got[2].note is None
    assert R.section_extract(df, " ").first().note == "section_extract_missing_query"


def memory(spark, tmp_path):
    now = dt.datetime(2024, 1, 1, 12)
    one = spark.createDataFrame([("s1", "spark joins explained", "[]", 3, now), ("s2", "x", "not json", 0, now - dt.timedelta(days=2))], "id string, query string, results string, n long, ts timestamp")
    two = spark.createDataFrame([("p1", "https://a.org/b", "Spark joins", "all about joins", "a.org", '{"w": 1}', now)], "id string, url string, title string, preview string, domain string, result string, ts timestamp")
    path = str(tmp_path / "memory")
    M.append(M.search_entries(one), path)
    M.append(M.page_entries(two), path)
    return M.read(spark, path)


def test_memory(spark, tmp_path):
    rows = memory(spark, tmp_path)
    assert {r.id: r.full_result for r in rows.collect()}["s2"] == '{"_raw":"not json"}'
    got = api.memory_search(rows, "spark joins", threshold=0.2).collect()
    assert got[0].id in ("s1", "p1") and all(r.score >= 0.2 for r in got)
    only = api.memory_search(rows, "spark joins", threshold=0.0, entry_type="scrape").collect()
    assert [r.id for r in only] == ["p1"] and only[0].topic == "https://a.org/b"
    assert M.top_domains(rows).collect()[0].domain == "a.org" and M.stats(rows).first().entries == 3
    probe = R.embedded(F.lit("Search: spark joins explained (3 results)"))
    assert M.recent_duplicate(rows, probe, F.lit(dt.datetime(2024, 1, 1, 13))).first().id == "s1"
    assert M.recent_duplicate(rows, probe, F.lit(dt.datetime(2024, 1, 5))).count() == 0
    assert M.is_rapid_testing(rows, probe, F.lit(dt.datetime(2024, 1, 1, 12))).first().rapid is False


def test_bfs(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.depth) for r in C.bfs(links, start, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert C.bfs(links, start, 9, 2).count() == 2


def test_crawl(spark):
    pages = spark.createDataFrame([("https://x.org/", [("https://x.org/a", ""), ("https://z.org/", "")]), ("https://x.org/a", [("https://x.org/b", "")])], "url string, links array<struct<url:string,text:string>>")
    got = {r.url: (r.depth, r.success) for r in C.crawl(spark, pages, "https://x.org/").collect()}
    assert got == {"https://x.org": (0, True), "https://x.org/a": (1, True), "https://x.org/b": (2, False)}
    s = C.summary(C.crawl(spark, pages, "https://x.org/")).first()
    assert (s.crawled, s.failed, s.max_depth, s.domains) == (2, 1, 2, ["x.org"])


def test_research(spark):
    f = spark.createDataFrame([(1, "https://a.org", "A", "benchmark of a model", 1, 10), (2, "https://b.org", "B", "nothing", 1, 5)], "ord long, url string, title string, content string, depth int, word_count long")
    text = D.report(f, "q").first().report
    assert "## Core concepts / state-of-the-art\n- [A](https://a.org)" in text and "_(no relevant sources found)_" in text and "(depth=1, ~5 words)" in text
    assert D.report(f.limit(0), "q").count() == 0
    logs = spark.createDataFrame([(1, '[{"url": "https://a"}, "https://b", {"url": "https://a"}]'), (2, '{"key_findings": [{"url": "https://c"}]}'), (3, "bad"), (4, None)], "id long, json string")
    assert {r.id: r.urls for r in D.logged_urls(logs).collect()} == {1: ["https://a", "https://b"], 2: ["https://c"], 3: [], 4: []}
    seen = spark.createDataFrame([("u1",)], "url string")
    c = spark.createDataFrame([("u1", 1), ("u2", 3), ("u2", 2), ("u3", 4)], "url string, ord long")
    assert [r.url for r in D.unseen(c, seen, 5).collect()] == ["u2", "u3"]


def test_engine_health_equals_a_fold(spark):
    r = random.Random(3)
    rows = [("e%d" % r.randrange(4), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=r.randrange(500)), i, r.choice(["success", "blocked", "recovered", "timeout", "failed"]), "r") for i in range(300)]
    want = {}
    for e, _, _, s, _ in sorted(rows, key=lambda x: (x[1], x[2])):
        b, t, f = want.get(e, (0, 0, 0))
        want[e] = {"success": (0, 0, 0), "blocked": (b + 1, 0, 0), "recovered": (b + 1, 0, 0), "timeout": (b, t + 1, 0), "failed": (b, t, f + 1)}[s]
    got = ST.engine_health(spark.createDataFrame(rows, "engine string, ts timestamp, id long, status string, reason string")).collect()
    assert {r.engine: (r.blocked_streak, r.timeout_streak, r.failure_streak) for r in got} == want


def test_proxy_fold(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("p", t, 1, True, 100), ("p", t, 2, True, 20), ("p", t, 3, False, None), ("q", t, 4, False, None), ("q", t, 5, False, None), ("q", t, 6, False, None), ("q", t, 7, True, 9)]
    got = {r.url: r for r in ST.proxy_state(spark.createDataFrame(rows, "url string, ts timestamp, id long, success boolean, latency_ms long")).collect()}
    assert (got["p"].latency_ms, got["p"].failure_count, got["p"].enabled) == (90, 1, True)
    assert (got["q"].latency_ms, got["q"].failure_count, got["q"].enabled) == (9, 0, False)


def test_host_guard(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("h", t, i, ok) for i, ok in enumerate([True, False, False, True, False])] + [("g", t, 1, True)]
    got = {r.bucket: r for r in ST.host_guard(spark.createDataFrame(rows, "bucket string, ts timestamp, id long, ok boolean")).collect()}
    assert got["h"].streak == 2 and got["h"].penalty_seconds == 10 and got["g"].streak == 0 and got["g"].penalty_seconds == 0


def test_engine_choice(spark):
    now = dt.datetime(2024, 1, 1, 12)
    later = now + dt.timedelta(minutes=5)
    e = spark.createDataFrame([(0, "a", None), (1, "b", later), (2, "c", None), (3, "d", now)], "idx int, engine string, cooldown_until timestamp")
    assert [r.engine for r in ST.chosen_engines(e, 2, F.lit(now)).orderBy("place").collect()] == ["c", "d", "a"]
    resting = e.withColumn("cooldown_until", F.lit(later) + F.make_dt_interval(F.col("idx")))
    assert [r.engine for r in ST.chosen_engines(resting, 2, F.lit(now)).collect()] == ["a"]
    tried = spark.createDataFrame([("a",), ("c",), ("d",)], "engine string")
    assert ST.rescue_engine(e, tried, F.lit(now)).first().engine == "b"


def test_sessions(spark, value):
    c = F.array(F.struct(F.lit(100.0).alias("expires")), F.struct(F.lit(-1.0).alias("expires")))
    assert value(ST.session_expiry(c, F.lit(5))) == 100.0
    assert value(ST.session_expiry(F.slice(c, 2, 1), F.lit(5))) == 86405.0
    assert value(ST.session_valid(F.lit(None).cast("double"), F.lit(5)))
    urls = spark.createDataFrame([("https://gist.github.com/x",), ("https://other.org/",)], "url string")
    s = spark.createDataFrame([("github_com", "cookie")], "key string, cookies string")
    assert {r.url: r.cookies for r in ST.session_of(urls, s).collect()} == {"https://gist.github.com/x": "cookie", "https://other.org/": None}


def test_proxies(spark):
    rows = spark.createDataFrame([("# none",), ("1.2.3.4:8080",), ("5.6.7.8:1080 # fast",), ("socks4://9.9.9.9:4145",), ("bad",), ("1.2.3.4:8080",), (None,)], "value string")
    got = {r.url: r for r in proxies.listed(rows).collect()}
    assert set(got) == {"http://1.2.3.4:8080", "socks5://5.6.7.8:1080", "socks4://9.9.9.9:4145"}
    assert got["socks5://5.6.7.8:1080"].priority == 3 and not got["socks4://9.9.9.9:4145"].supported
    assert proxies.listed(rows, "http").count() == 1


def test_streaming_matches_batch(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i % 3, "click", float(i)) for i in range(48)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = EV.tumbling(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tumbled").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, EV.tumbling(df).collect()))
    assert EV.distinct(df.union(df)).count() == 48


def test_queries_read_whole_turns(spark, tmp_path):
    from webloom import catalogue
    from webloom.functions import text as T

    turns = [(1, 0, "system", "be brief"), (1, 1, "user", "a word of greeting, then stack overflow error"), (4, 3, "user", "a word of greeting, then nothing else")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    q = catalogue._user_queries(spark, str(tmp_path))
    got = {(r.conv_id, r.turn): r for r in q.select("conv_id", "turn", "q", T.recovery_queries(F.col("q"), T.rewritten(F.col("q"))).alias("s")).collect()}
    assert set(got) == {(1, 1), (4, 3)}
    assert got[1, 1].q.endswith("stack overflow error") and any("stack overflow error" in x for x in got[1, 1].s)
    assert any("nothing else" in x for x in got[4, 3].s)


def test_grounded_counts_equal_all_pairs(spark):
    import random

    from webloom.functions import quality as Q
    from webloom.operators import extract

    r = random.Random(3)
    words = ["the", "theme", "a", "an", "report", "reports", "Zürich", "x1", "blue", "green", "greenhouse", "of"]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 25)))) for i in range(60)] + [(60, None), (61, ""), (62, "THE-report"), (62, "THE-report"), (None, "blue green of")]
    values = [(i, " ".join(r.choice(words) for _ in range(r.randrange(1, 9)))) for i in range(40)] + [(40, "a"), (41, "!? ..--"), (42, "of an"), (43, "blue, GREEN"), (44, "nothing there")]
    d, v = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(values, "id long, value string")
    got = {x.id: x.grounded for x in extract.grounded_counts(v, d).collect()}
    pairs = v.crossJoin(d).groupBy("id").agg(F.count_if(Q.is_grounded(F.col("value"), F.col("text"))).alias("n"))
    assert got == {x.id: x.n for x in pairs.collect()} and len(got) == len(values)


def test_placed_numbers_all_rows(spark):
    from webloom.operators import store

    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), "id")
    got = {x.k: x.place for x in store.placed(rows.repartition(5), F.desc("k"), "id").collect()}
    assert got == {k: 1000 - k for k in range(1000)}
    assert store.placed(rows.where("false"), "k").count() == 0


def test_shared_links_walk(spark):
    from webloom.operators import crawl

    links = [(0, "a"), (1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "c"), (4, "z"), (0, "a")]
    got = crawl.shared_links(spark.createDataFrame(links, "page_id long, href string"), spark.createDataFrame([(0,)], "node long"), 2)
    assert sorted((x.node, x.depth) for x in got.collect()) == [(0, 0), (1, 1), (2, 2)]


def test_extras_of_engines(spark):
    from webloom.operators import search

    rows = [(2, ["r2"], None, ["w"], "second", None), (1, ["r1", "x"], ["s"], None, None, None), (3, [], [], ["w"], "third", "42")]
    kinds = "ord long, related array<string>, suggestions array<string>, warnings array<string>, rewrite string, answer string"
    x = search.merged_extras(spark.createDataFrame(rows, kinds)).first()
    assert (x.related, x.suggestions, x.warnings, x.rewrite, x.answer) == (["r1", "x", "r2"], ["s"], ["w", "w"], "second", "42")
    base = "ord long, engine string, url string, title string, content string, published_at string, domain string, source_type string, breadcrumbs array<string>, top_answer string"
    found = spark.createDataFrame([(1, "a", "https://h.example/", "", "c", None, "h", "other", ["h"], None), (2, "b", "https://h.example/", "t", "", None, "h", "other", ["H", "x"], "yes")], base)
    (m,) = search.merged(found).collect()
    assert m.top_answer == "yes" and m.breadcrumbs == ["h", "x"] and m.title == "t" and m.content == "c"


def test_shave_gate_with_a_model(spark):
    from webloom.operators import relevance as R

    long_ = " ".join(["apple"] * 300 + ["stone"] * 300)
    rows = [("a", long_, 600, None), ("b", "short text", 2, ["short_content"]), ("c", None, None, None)]
    df = spark.createDataFrame(rows, "url string, clean_content string, word_count long, warnings array<string>")
    embed = lambda c: F.array(F.when(F.contains(c, F.lit("apple")), 1.0).otherwise(0.0), F.when(F.contains(c, F.lit("stone")), 1.0).otherwise(0.0))
    got = {r.url: r for r in R.gated(df, "apple", threshold=0.9, embed=embed).collect()}
    assert got["a"].warnings == ["semantic_shave: kept 2/5 chunks (600 → 400 words)"] and "stone" not in got["a"].clean_content and got["a"].word_count == 400
    assert got["b"].warnings == ["short_content", "semantic_shave: bypassed (word_count < 200)"] and got["b"].clean_content == "short text"
    assert got["c"].warnings is None and got["c"].clean_content is None
    assert {r.url: r.warnings for r in R.gated(df, None).collect()}["a"] == ["semantic_shave_missing_query"]


def test_shaved_rows_of_one_id_stay_apart(spark):
    one, two = " ".join(["alpha beta"] * 190 + ["delta epsilon"] * 100), " ".join(["gamma"] * 150 + ["delta"] * 200)
    alone = {t: R.shaved(spark.createDataFrame([(i, t)], "id long, text string"), "delta epsilon", 0.8).first() for i, t in enumerate((one, two))}
    both = R.shaved(spark.createDataFrame([(7, one), (7, two), (7, one)], "id long, text string"), "delta epsilon", 0.8).collect()
    assert sorted((r.text, r.kept, r.total) for r in both) == sorted((alone[t].text, alone[t].kept, alone[t].total) for t in (one, two, one))
    assert {r.id for r in both} == {7}


def queue_walk(links, start, budget, wave, max_depth):
    """A crawl by hand: first in, first out, marked when found."""
    queue, depth, order = [start], {start: 0}, []
    while queue and len(order) < budget:
        batch, queue = queue[: min(wave, budget - len(order))], queue[min(wave, budget - len(order)) :]
        order += batch
        for node in batch:
            for dst in links.get(node, []) if depth[node] < max_depth else []:
                if dst not in depth:
                    depth[dst] = depth[node] + 1
                    queue.append(dst)
    return [(n, depth[n]) for n in order]


def test_frontier_equals_a_queue_and_goes_on(spark, tmp_path):
    rng = random.Random(8)
    links = {f"n{i}": [f"n{rng.randrange(60)}" for _ in range(rng.randrange(7))] for i in range(60)}
    rows = spark.createDataFrame([(a, i, b) for a, out in links.items() for i, b in enumerate(out)], "src string, at int, dst string").cache()
    asked = []

    def expand(wave):
        asked.append(wave.count())
        return rows.join(wave, F.col("src") == F.col("node")).select("place", "at", "dst")

    start = spark.createDataFrame([("n0",)], "node string")
    for k, (budget, wave, depth) in enumerate(((25, 4, 9), (60, 7, 2), (5, 10, 3), (1, 3, 3), (200, 9, 20))):
        asked.clear()
        got = C.Frontier(spark, f"{tmp_path}/{k}", budget, wave, depth).run(start, expand)
        assert [(r.node, r.depth) for r in got.orderBy("place").collect()] == queue_walk(links, "n0", budget, wave, depth)
        assert sum(asked) <= budget
    # a crawl that stopped after its third wave, with a fourth that is not whole
    (tmp_path / "4/wave=3/_SUCCESS").unlink()
    for left in range(4, 30):
        if (tmp_path / f"4/wave={left}/_SUCCESS").exists():
            (tmp_path / f"4/wave={left}/_SUCCESS").unlink()
    assert [(r.node, r.depth) for r in C.Frontier(spark, f"{tmp_path}/4", 200, 9, 20).run(start, expand).orderBy("place").collect()] == queue_walk(links, "n0", 200, 9, 20)


def test_proxy_lines_match_each_pattern_once(spark):
    from webloom.sources import proxies

    rows = spark.createDataFrame([(x,) for x in ("https://u:p@h.example:3128 # fast", "h.example:443", "https://h.example:443", "sock5://h:1080", "nothing", None, "x://h:1")], "value string")
    got = proxies.lines(rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") <= 8 and plan.count("regexp_replace(") <= 3, plan
    want = [("https://u:p@h.example:3128", "https", "h.example", 3128), ("https://h.example:443", "https", "h.example", 443), ("https://h.example:443", "https", "h.example", 443), ("sock5://h:1080", "socks5", "h", 1080)]
    assert sorted((r.url, r.scheme, r.host, r.port) for r in got.collect()) == sorted(want)
    some = proxies.listed(rows, "https", 5)
    assert [r.url for r in some.collect()] == ["https://h.example:443", "https://u:p@h.example:3128"]


def test_grounded_counts_read_each_text_once(spark, monkeypatch):
    from webloom.operators import extract

    values = spark.createDataFrame([(1, "Red red apple"), (2, "ab"), (3, "one two six ten"), (4, None), (5, "x-y z1"), (6, "apple pie")], "id long, value string")
    docs = spark.createDataFrame([(1, "the REDDISH apples"), (2, None), (3, "one two"), (4, "onetwosix"), (5, "an x-y z1"), (6, "")], "doc_id long, text string")
    got = extract.grounded_counts(values, docs)
    want = sorted(map(tuple, got.collect()))
    assert want == [(1, 1), (2, 6), (3, 1), (4, 0), (5, 6), (6, 0)]
    monkeypatch.setattr(extract, "NEAR", -1)
    joined = extract.grounded_counts(values, docs)
    assert sorted(map(tuple, joined.collect())) == want
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString() and "MapInArrow" not in joined._jdf.queryExecution().executedPlan().toString()
