import datetime as dt

import pytest
from pyspark.sql import functions as F

from webloom.functions import fields as X
from webloom.functions import quality as Q
from webloom.functions import text as T
from webloom.functions import url as U


def test_tokens(value):
    got = value(T.tokens(F.lit("Hello World! This is a Test-case.")))
    assert {"hello", "world", "this", "test", "case"} == set(got)


def test_clean_text_and_words(value):
    assert value(T.clean_text(F.lit("  This   is    \n\n\n   some    text   \n\n  "))) == "This is some text"
    assert value(T.word_count(F.lit("This is a test with five words"))) == 7
    assert value(T.word_count(F.lit(None).cast("string"))) == 0


def test_relevance(value):
    q = T.query_tokens("rust programming tutorial")
    rust = value(T.relevance(q, F.lit("Rust Programming Tutorial"), F.lit("learn rust")))
    python = value(T.relevance(q, F.lit("Python Guide"), F.lit("learn python programming")))
    assert rust == 1.0 and rust > python > 0
    assert value(T.relevance([], F.lit("a"), F.lit("b"))) == 0.5


@pytest.mark.parametrize("q,dev", [("rust programming tutorial", True), ("how to use tokio", True), ("python api documentation", True), ("javascript error handling", True), ("coffee shops near me", False), ("weather forecast", False)])
def test_developer_queries(value, q, dev):
    assert value(T.is_developer_query(F.lit(q))) is dev


def test_rewritten(value):
    assert value(T.rewritten(F.lit("rust docs"))) == "rust docs site:doc.rust-lang.org"
    assert value(T.rewritten(F.lit("coffee shops"))) is None
    assert value(T.rewritten(F.lit("rust docs site:x.org"))) is None
    assert value(T.suggestions(F.lit("python bug")))[-1] == "python bug site:stackoverflow.com"
    assert "rust docs" not in value(T.recovery_queries(F.lit("rust docs"), F.lit("rust docs")))


@pytest.mark.parametrize("a,b,same", [("rust programming", "rust", True), ("how to use rust", "how to use rust async", True), ("rust", "python", False), ("javascript", "java", False), ("a b c d", "a b c e", True)])
def test_similar_queries(value, a, b, same):
    assert value(T.is_similar_query(F.lit(a), F.lit(b))) is same


def test_community(value):
    assert value(T.wants_community(F.lit("x reddit discussion"), F.lit(20)))
    assert value(T.wants_community(F.lit("x"), F.lit(2)))
    assert not value(T.wants_community(F.lit("x"), F.lit(8)))


def test_json_noise(value):
    assert value(T.is_json_noise(F.lit('{"payload":{"codeLineWrapEnabled":false,"refInfo":{}}}')))
    assert not value(T.is_json_noise(F.lit('{"a":1}')))
    assert not value(T.is_json_noise(F.lit("pip install unsloth")))


def test_dates(value):
    assert tuple(value(T.date_prefix(F.lit("Jan 10, 2024 — text here")))) == ("Jan 10, 2024", "text here")
    assert tuple(value(T.date_prefix(F.lit("no date here")))) == (None, "no date here")
    assert value(T.published_at(F.lit("seen 2024-01-10 and Jan 2, 2025"))) == "2024-01-10"
    as_of = F.lit(dt.date(2024, 2, 1))
    assert [value(T.recency_bonus(T.parsed_date(F.lit(d)), as_of)) for d in ("2024-03-01", "Jan 20, 2024", "2023-06-01", "2020-01-01", "x")] == [0.05, 0.25, 0.1, 0.0, 0.0]


def test_chunks(value):
    words = " ".join(f"w{i}" for i in range(450))
    got = value(T.chunks(F.lit(words)))
    assert [c.split()[0] for c in got] == ["w0", "w100", "w200", "w300"] and got[-1].split()[-1] == "w449"
    assert value(T.chunks(F.lit("short  text"))) == ["short  text"]
    assert value(T.chunks(F.lit("  "))) == []


def test_sections(value):
    assert value(T.sections(F.lit("intro\n# A\ntext\n####### no\n## B\nx"))) == ["intro", "# A\ntext\n####### no", "## B\nx"]


def test_topic(value):
    assert value(T.topic(F.lit("a Very Long question about spark joins today"), F.lit("search"))) == "very long question about spark"
    assert value(T.topic(F.lit("a b"), F.lit("scrape"))) == "general_scrape"


def test_preprocess(value):
    got = value(T.preprocess_html(F.lit('<div class="x"><script>var t="</p>";</script><p id="a" lang="en">Hi</p><nav>n</nav></div>')))
    assert "script" not in got and "nav" not in got and 'lang="en"' in got and "class" not in got


@pytest.mark.parametrize(
    "url,key",
    [
        ("https://Ex.org/a?utm_x=1&b=2&a=1#top", "https://Ex.org/a?a=1&b=2"),
        ("https://ex.org/a?ref=x", "https://ex.org/a"),
        ("https://ex.org/a?z", "https://ex.org/a?z="),
        ("not a url", "not a url"),
    ],
)
def test_search_key(value, url, key):
    got = value(U.search_key(F.lit(url)))
    assert got == key and value(U.search_key(F.lit(got))) == key


def test_crawl_key(value):
    assert value(U.crawl_key(F.lit("https://Ex.org/A/?q=#x"))) == "https://ex.org/a"
    assert value(U.crawl_key(F.lit("https://ex.org/a?q=1"))) == "https://ex.org/a?q=1"


@pytest.mark.parametrize("href,url", [("/b", "https://ex.org/b"), ("c.html", "https://ex.org/a/c.html"), ("//x.org/d", "https://x.org/d"), ("http://y.org", "http://y.org"), ("#t", None), ("mailto:a@b.c", None), ("javascript:f()", None), ("?p=2", "https://ex.org/a/b?p=2"), ("ftp://z", None)])
def test_resolved(value, href, url):
    assert value(U.resolved(F.lit("https://ex.org/a/b?x=1"), F.lit(href))) == url


def test_clean_content_url(value):
    assert value(U.clean_content_url(F.lit("https://github.com/microsoft/vscode/blob/main/README.md"))) == "https://raw.githubusercontent.com/microsoft/vscode/main/README.md"
    assert value(U.clean_content_url(F.lit("https://github.com/user/repo"))) == "https://raw.githubusercontent.com/user/repo/HEAD/README.md"
    assert value(U.clean_content_url(F.lit("https://github.com/user/repo/issues/1"))) is None
    assert value(U.plain_view_url(F.lit("https://github.com/u/r/issues/1"))) == "https://github.com/u/r/issues/1?plain=1"


def test_hrefs(value):
    assert value(U.unwrapped_google(F.lit("/url?q=https%3A%2F%2Fx.org%2Fa&sa=U"))) == "https://x.org/a"
    assert value(U.unwrapped_bing(F.lit("https://www.bing.com/ck/a?u=a1aHR0cHM6Ly94Lm9yZy9h&x=1"))) == "https://x.org/a"
    assert value(U.unwrapped_duckduckgo(F.lit("//duckduckgo.com/l/?uddg=https%3A%2F%2Fx.org%2Fa"))) == "https://x.org/a"


def test_hosts(value):
    assert value(U.parent_key(F.lit("gist.github.com"))) == "github_com"
    assert value(U.parent_key(F.lit("github.com"))) is None
    assert value(U.breadcrumbs(F.lit("https://ex.org/a//b/c/d"))) == ["ex.org", "a", "b", "c"]
    assert value(U.masked_credentials(F.lit("http://u:secret@h:80"))) == "http://u:***@h:80"
    assert tuple(value(U.host_port(F.lit("h:8080")))) == ("h", 8080)
    assert value(U.host_port(F.lit("h:99999"))) is None
    assert value(U.should_crawl(F.lit("https://notexample.com/a"), F.lit("example.com")))
    assert not value(U.should_crawl(F.lit("https://notexample.com/a"), F.lit("example.com"), strict=True))


def test_domain_weight(value):
    w = lambda d, k, t: value(U.domain_weight(F.lit(d), F.lit(k), F.lit(t)))
    assert w("github.com", "repo", "code") == pytest.approx(1.75)
    assert w("doc.rust-lang.org", "docs", "general") == pytest.approx(1.8225)
    assert w("x.gov", "other", "general") == 1.5
    assert w("googlesyndication.com", "gaming", "general") == 0.1


def test_blocks(value):
    assert value(Q.block_reason(F.lit("<p>Please verify you are human</p>"))) == "Human Verification"
    assert value(Q.block_reason(F.lit("captcha " + "x" * 500_001))) is None
    assert value(Q.serp_block_reason(F.lit(429), F.lit(""))) == "http_429"
    assert value(Q.serp_block_reason(F.lit(200), F.lit("blocked"))) == "block_page"


def test_auth(value):
    assert value(Q.is_auth_wall(F.lit("Please sign in")))
    assert value(Q.is_auth_wall(F.lit("Sign in or sign up")))
    assert not value(Q.is_auth_wall(F.lit("Sign in or sign up " + "word " * 90)))
    html = '<title>Sign in - X</title><form action="/login"><input type="password"></form>'
    factors = Q.auth_factors(F.lit(html), F.lit("please log in"), F.lit("https://x.org/login"))
    assert {f["factor"] for f in value(factors)} == {"high_confidence_auth_keyword", "dom_login_selector", "dom_auth_form_action", "auth_page_title", "auth_url_pattern"}
    assert value(Q.auth_risk(factors)) == 1.0


def test_scores(value):
    assert value(Q.extraction_score(F.lit(600), F.lit("2024"), F.lit(1), F.lit(3))) == pytest.approx(1.0)
    assert value(Q.extraction_score(F.lit(0), F.lit(None), F.lit(0), F.lit(0))) == 0.0
    assert value(Q.reading_minutes(F.lit(201))) == 2 and value(Q.reading_minutes(F.lit(0))) == 1
    assert [value(Q.backoff_seconds(F.lit(25), F.lit(n), F.lit(600))) for n in (0, 1, 2, 5, 9)] == [25, 25, 50, 400, 400]
    assert value(Q.match_band(F.lit(0.7))) == "High"
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert value(Q.cosine(a(1, 0), a(1, 1))) == pytest.approx(0.70710678)
    assert value(Q.cosine(a(1), a(1, 1))) == 0.0 and value(Q.cosine(a(0, 0), a(1, 1))) == 0.0


def test_grounded(value):
    assert value(Q.is_grounded(F.lit("quick brown fox"), F.lit("The Quick brown dog and fox")))
    assert not value(Q.is_grounded(F.lit("entirely other words"), F.lit("The quick brown fox")))
    assert value(Q.is_grounded(F.lit("abc"), F.lit("zzz")))


def test_page_type(value):
    p = lambda u, t="", n=0, w=100: value(Q.page_type(F.lit(u), F.lit(t), F.lit(""), F.lit(n), F.lit(w), F.lit(None)))
    assert p("https://x.org/", w=10) == "landing_page"
    assert p("https://www.rust-lang.org/learn", "Learn Rust") == "documentation"
    assert p("https://x.org/blog/a") == "article" and p("https://x.org/pricing") == "product" and p("https://x.org/a") == "webpage"


def test_field_patterns(value):
    assert value(X.emails(F.lit("a@b.org, c.d@e.co"))) == ["a@b.org", "c.d@e.co"]
    assert value(X.phones(F.lit("call (743) 555-3824 or 12"))) == ["(743) 555-3824"]
    assert value(X.prices(F.lit("$1,299.00 or 20 EUR")))[0] == "$1,299.00"
    assert value(X.number_near(F.lit("Downloads: 1,234 today"), "downloads")) == 1234.0
    assert value(X.text_near(F.lit("Author: Jane Doe\nnext"), "author_name")) == "Jane Doe"
    assert value(X.list_near(F.lit("Features:\n- one\n- two\nend"), "features")) == ["one", "two"]


def test_rustdoc(value):
    md = F.lit("[Adam](struct.Adam.html) [Module](trait.Module.html) [conv2d](fn.conv2d.html) [init](init/index.html)")
    assert value(X.rustdoc_symbols(md, "struct")) == ["Adam"]
    assert value(X.rustdoc_symbols(md, "trait")) == ["Module"]
    assert value(X.rustdoc_symbols(md, "fn")) == ["conv2d"]
    assert value(X.rustdoc_modules(md)) == ["init"]


def test_schema_from_prompt():
    four = X.schema_from_prompt("fields: page_title, page_type, main_topics (array of strings), and summary")
    assert [f.name for f in four] == ["page_title", "page_type", "main_topics", "summary"] and four[2].kind == "array"
    assert [f.name for f in X.schema_from_prompt("{structs, traits, functions}")] == ["structs", "traits", "functions"]
    assert [f.name for f in X.schema_from_prompt('{"fields": [{"name": "a", "type": "number"}]}')] == ["a"]
    assert X.schema_from_prompt("nothing here") is None


def test_more_urls(value):
    assert value(U.is_tutorial(F.lit("https://docs.x.org/a"))) and value(U.is_tutorial(F.lit("https://x.org/guide"))) and not value(U.is_tutorial(F.lit("https://x.org/a")))
    assert value(U.needs_browser(F.lit("https://mobile.x.com/a"))) and not value(U.needs_browser(F.lit("https://notx.com/")))
    assert value(U.browser_first(F.lit("https://a.org"), "high"))


def test_noise_and_prefixes(value):
    assert value(Q.is_high_noise(F.lit("\n".join(["share", "reply now please"] * 6))))
    assert not value(Q.is_high_noise(F.lit("one line")))
    assert value(T.byte_prefix(F.lit("aé日"), 3)) == "aé" and value(T.byte_prefix(F.lit("aé日"), 5)) == "aé" and value(T.byte_prefix(F.lit("abc"), 9)) == "abc"
    assert value(T.paragraphs_within(F.array(F.lit("a" * 400), F.lit("b" * 200), F.lit("c")), 100)) == ["a" * 400, "b" * 200]
    assert value(T.research_queries(F.lit(" Rust  x ")))[0] == "Rust  x"
    assert value(Q.preflight(F.lit(200), F.lit("captcha")))["rejected"] and value(Q.engine_timeout_ms(F.lit("brave"))) == 3500


def test_requests():
    from webloom.plans.config import Research

    r = Research.of({"query": " q ", "depth": 99, "max_sources": 999, "max_concurrent": 999, "max_chars_per_source": 0, "relevance_threshold": 2.0})
    assert (r.query, r.depth, r.max_sources, r.max_concurrent, r.max_chars, r.threshold) == ("q", 3, 20, 10, 1, 1.0)
    for bad in ({"query": " "}, {"query": "q", "quality_mode": "turbo"}):
        with pytest.raises(ValueError):
            Research.of(bad)


def test_cache_and_sql(spark, tmp_path):
    from webloom.plans import sql_functions
    from webloom.sources import cache

    now = F.lit(dt.datetime(2024, 1, 1))
    path = str(tmp_path / "cache")
    cache.write(spark.createDataFrame([(1,)], "a int"), path, "q", now)
    assert cache.read(spark, path, "q", now).first()["a"] == 1 and cache.read(spark, path, "other", now).count() == 0
    assert cache.read(spark, path, "q", F.lit(dt.datetime(2024, 1, 2))).count() == 0
    assert "web_words" in sql_functions.register(spark)
    r = spark.sql("select web_words(' a b '), web_tokens('Ab abc'), web_domain('https://X.org/a'), web_cosine(array(1f, 0f), array(1f, 0f)), web_band(0.95D)").first()
    assert tuple(r) == (2, ["abc"], "x.org", 1.0, "Exact")


def test_needles_overlap_and_are_found_once(spark):
    from webloom.functions import needles as N

    rows = spark.createDataFrame([("javascript and java",), ("ajava",), ("",), (None,), ("c++ x" * 4000,)], "t string")
    words = ["java", "javascript", "script", "ava", "c++", "", "java", "z"]
    got = [r.h for r in rows.select(N.hits(F.col("t"), words).alias("h")).collect()]
    assert got == [["java", "javascript", "script", "ava"], ["java", "ava"], [], [], ["c++"]]
    assert [r.h for r in rows.select(N.hits(F.col("t"), []).alias("h")).collect()] == [[]] * 5


def test_query_forms(spark):
    """One pass over the needles gives what the functions give one by one."""
    qs = ["rust docs", "how to use tokio", "coffee", "python bug", "rust docs site:x.org", None]
    got = {r.q: r for r in T.query_forms(spark.createDataFrame([(q,) for q in qs], "q string"), "q").collect()}
    assert got["rust docs"].rewritten == "rust docs site:doc.rust-lang.org"
    assert [got[q].rewritten for q in ("coffee", "rust docs site:x.org", None)] == [None] * 3
    assert got["python bug"].suggestions[-1] == "python bug site:stackoverflow.com" and got["coffee"].suggestions == []
    assert "rust docs" not in got["rust docs"].recovery and got["coffee"].recovery == []
