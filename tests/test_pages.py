import json


from webloom.functions.fields import Field
from webloom.operators import extract as E
from webloom.sources import dom, serp
from webloom.sources import pages as P

ARTICLE = " ".join(f"word{i}" for i in range(120))
PAGE = f"""<!doctype html><html lang="en"><head><title>Learn  Rust</title><meta name="description" content="D">
<meta property="og:site_name" content="Site"><meta property="og:image" content="/i.png"><meta name="author" content="Ann">
<meta property="article:published_time" content="2024-01-02"><link rel="canonical" href="/c"></head><body>
<nav><ul><li><a href="/a">A</a></li></ul></nav><!-- no --><div class="ad">Buy</div>
<article><h2>Second</h2><h1>First</h1><p>{ARTICLE}</p><p>Fish &amp; chips</p><img src="p.png" alt="Pic">
<pre><code class="language-python">print("hello world")</code></pre>
<a href="/x">x</a><a href="/y#t">y</a><a href="/x">again</a><a href="mailto:a@b.c">m</a><a href="z">z</a></article>
<script type="application/ld+json">{json.dumps({"@type": "Product", "name": "Kettle", "offers": {"price": 12}})}</script></body></html>"""


def rows(spark, *pages):
    return P.parsed(spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string"))


def test_page_row(spark):
    r = P.scored(rows(spark, ("https://www.rust-lang.org/learn", PAGE))).first()
    assert (r.title, r.meta_description, r.site_name, r.author, r.published_at, r.language) == ("Learn Rust", "D", "Site", "Ann", "2024-01-02", "en")
    assert r.og_image == "https://www.rust-lang.org/i.png" and r.canonical_url == "https://www.rust-lang.org/c"
    assert [(h.level, h.text) for h in r.headings] == [("h1", "First"), ("h2", "Second")]
    assert [x.url for x in r.links] == [f"https://www.rust-lang.org/{p}" for p in ("x", "y#t", "z")]
    assert r.code_blocks[0].language == "python" and r.images[0].src.endswith("/p.png")
    assert "Fish & chips" in r.clean_content and "Buy" not in r.clean_content and "### Image Context" in r.clean_content
    assert r.page_type == "documentation" and r.embedded_sources[0].source_type == "json-ld" and r.word_count > 120


def test_empty_and_null_pages(spark):
    got = P.scored(rows(spark, (None, None), ("", ""), ("x", "<p"))).collect()
    assert [r.title for r in got] == ["No Title"] * 3 and [r.word_count for r in got] == [0, 0, 1]


def test_fetched(spark):
    pages = spark.createDataFrame([(1, "https://a.org/", PAGE)], "page_id long, url string, html string")
    urls = spark.createDataFrame([("https://a.org/",), ("https://b.org/",)], "url string")
    got = {r.url: r for r in P.fetched(urls, pages, 50).collect()}
    assert got["https://a.org/"].success and got["https://a.org/"].truncated and "content_truncated" in got["https://a.org/"].warnings
    assert not got["https://b.org/"].success and got["https://b.org/"].failure_reason == "not_found"


def test_extraction_and_confidence(spark):
    r = P.scored(rows(spark, ("https://www.rust-lang.org/learn", PAGE)))
    e = E.extracted(r, [Field("page_type"), Field("main_topics", "array of strings"), Field("title")]).first()
    assert e.data["page_type"] == ["documentation"] and e.data["main_topics"] == ["Second"] and e.confidence > 0.9 and set(e.data) == {"page_type", "main_topics", "title"}


def test_placeholder(spark):
    r = P.scored(rows(spark, ("https://x.org/a", "<title>T</title><p>just five words right here</p>")))
    e = E.extracted(r, [Field("version"), Field("downloads_total", kind="number")]).first()
    assert e.confidence == 0.0 and "placeholder_page" in e.warnings
    arrays = E.extracted(r, [Field("structs"), Field("traits")]).first()
    assert "placeholder_page" not in arrays.warnings


def test_json_ld():
    root = dom.parse(PAGE)
    assert dom.linked_data(root) == "Product: Kettle\nPrice: 12"
    many = {"@graph": [{"@type": "Article", "headline": "H", "author": [{"name": "A"}, "B"]}, {"@type": "Organization", "name": "O"}]}
    assert dom.linked_data(dom.parse(f'<script type="application/ld+json">{json.dumps(many)}</script>')) == "Title: H\nAuthor: A, B\n---\nOrganization: O"


def test_page_state():
    payload = {"payload": {"blob": {"text": "# Hello\nThis is the file content."}}}
    assert dom.hosted_file(payload) == "# Hello\nThis is the file content."
    assert dom.flattened({"b": {"c": "x", "id": "no"}, "a": ["p", "q"], "n": 1}) == ["a: p, q", "b.c: x", "n: 1"]


def test_markdown():
    assert dom.normalized_markdown(r"This is \#heading and \_italic\_ and \*bold\*") == "This is #heading and _italic_ and *bold*"
    assert dom.normalized_markdown("```\na \\# b\n```") == "```\na \\# b\n```"
    link = "[Home](https://example.com)"
    assert dom.normalized_markdown(f"{link}\n{link}\nprose\n{link}").count("Home") == 2


def test_noise():
    assert dom.collapsed_runs("a b c d " * 7 + "end", 4, 5) == "a b c d end"
    assert dom.collapsed_runs("a b", 4, 5) == "a b"
    assert dom.post_cleaned("Cookie settings\nReal text here", line_aware=True) == "Real text here"
    assert dom.post_cleaned("Cookie settings\nReal text here") == ""


def test_imports():
    code = "\n".join(["import a", "import b", "import c", "from d import e", "# TODO keep"] + [f"x{i} = {i}" for i in range(11)])
    out = dom.without_imports(code, "python")
    assert "import a" not in out and "x0 = 0" in out
    assert dom.without_imports("import a\nx", "python") == "import a\nx"


def test_contextual_code():
    got = dom.contextual_code("First. Then run this now:\n```sh\nls\n```\n", [{"language": None, "code": "raw"}])
    assert [(c["language"], c["code"]) for c in got] == [("sh", "ls"), (None, "raw")] and got[0]["context"].startswith("Then run")


def test_serp(spark):
    google = '<div id="search"><div class="MjjYud"><a href="/url?q=https%3A%2F%2Fx.org%2Fdocs"><h3>X</h3></a><div class="VwiC3b">Jan 10, 2024 — about x</div></div><div class="MjjYud"><a href="https://maps.google.com/"><h3>G</h3></a></div></div>'
    bing = '<li class="b_algo"><h2><a href="https://www.bing.com/ck/a?u=a1aHR0cHM6Ly94Lm9yZy9h">B</a></h2><div class="b_caption"><p>snip</p></div></li>'
    ddg = '<div class="results_links"><a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fd.org%2F">D</a><a class="result__snippet">s</a></div>'
    brave = '<main><div><a href="https://br.org/"><h3>R</h3></a><div class="snippet-description">q</div></div><a href="/local">no</a></main>'
    df = spark.createDataFrame([(1, "google", google), (2, "bing", bing), (3, "duckduckgo", ddg), (4, "brave", brave), (5, "google", None)], "serp_id long, engine string, html string")
    got = {r.serp_id: r for r in serp.parsed(df).collect()}
    assert (got[1].url, got[1].content, got[1].published_at) == ("https://x.org/docs", "about x", "Jan 10, 2024")
    assert got[2].url == "https://x.org/a" and got[3].url == "https://d.org/" and got[4].url == "https://br.org/" and len(got) == 4


def test_batch_summary_fetches_every_page(spark, tmp_path):
    from webloom import catalogue

    pages = [(i, f"https://example.com/{i}", PAGE) for i in range(1, 12)] + [(13, "https://example.com/3", PAGE), (15, "https://example.com/empty", "<html></html>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    (got,) = catalogue.batch_summary(spark, str(tmp_path)).collect()
    made_up = sum(i % 5 == 0 for i, _, _ in pages)
    assert (got.total, got.successful, got.failed) == (len(pages) + made_up, len(pages) - 1, 1 + made_up)
