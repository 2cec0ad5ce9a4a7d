"""References cut short, runs of like parts."""

from webloom.sources import content as C
from webloom.sources import dom


def test_references_without_semicolon_are_text():
    root = dom.parse('<title>a &amp;&amp;&lt; b &amp</title><script>if (a && b) x("&amp");</script><a href="/?a=1&copy=2">c & d</a>')
    assert dom.title(root) == "a &&< b &amp"
    assert root.first("script").raw_text() == 'if (a && b) x("&amp");'
    assert (root.first("a").get("href"), root.first("a").text()) == ("/?a=1&copy=2", "c & d")


def test_runs_of_like_parts_stay_where_asked():
    html = "<article>" + "<p>we like it here very much indeed</p>" * 60 + "<p>no more</p></article>"
    root = dom.parse(html)
    whole, few = C.Index(root, runs=True), C.Index(root)
    assert [dom.words(f(whole) or "") for f in (C.heuristic, C.fallback, C.text_only, C.book)] == [422] * 4
    assert dom.words(C.heuristic(few)) == 2
    assert C.main(root, "NewsArticle", runs=True)[1] == "readable"


def test_pages_are_handed_on_in_slices():
    import pyarrow as pa

    from webloom.sources import pages as P

    batch = pa.RecordBatch.from_pydict({"page_id": list(range(150))})
    got = list(P._slices(iter([batch])))
    assert [len(s) for s in got] == [64, 64, 22] and got[2][-1] == {"page_id": 149}


def test_h1_decodes_what_its_sql_does(spark, tmp_path):
    from webloom import catalogue

    html = '<html lang="en"><title>a &quot;b&quot; &amp; c</title><body><h1>d = &quot;e&quot; &amp;lt; f &amp;&lt;</h1></body></html>'
    spark.createDataFrame([(1, "https://example.com/1", html)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert [tuple(r) for r in catalogue.page_h1(spark, str(tmp_path)).collect()] == [(1, "d = &quot;e&quot; &lt; f &&lt;")]
    assert dom.headings(dom.parse(html))[0]["text"] == 'd = "e" &lt; f &<'


def test_title_decodes_what_its_sql_does(spark, tmp_path):
    from webloom import catalogue

    html = '<html lang="en"><title>token = &quot;7a8f&quot; &amp;quot; &amp</title><body><h1>other</h1></body></html>'
    spark.createDataFrame([(1, "https://example.com/1", html)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert [tuple(r) for r in catalogue.page_title_lang(spark, str(tmp_path)).collect()] == [(1, "token = &quot;7a8f&quot; &quot; &amp", "en")]
    assert dom.title(dom.parse(html)) == 'token = "7a8f" &quot; &amp'


def test_short_repeated_texts_count_whole_where_asked():
    page = lambda body: dom.parse(f"<body><div class=ad>Buy this thing now</div><article><h1>Ed, Ed,</h1>{body}</article></body>")
    whole = lambda body: C.main(page(body), "NewsArticle", runs=True)
    said = "Ed, " * 30 + "and"
    assert whole(f"<p>{said}</p>") == (f"Ed, Ed, {said}", "readable")
    assert C.main(page(f"<p>{said}</p>"), "NewsArticle")[1] == "whole"  # by default it is three words and gives way to the page
    short = "<p>of the and of the and</p>" * 12
    assert whole(short) == ("Ed, Ed, " + " ".join(["of the and of the and"] * 12), "heuristic")
    assert C.main(page(short), "NewsArticle", runs=False)[1] != "heuristic"
    assert whole("<p>Few words</p>") == ("Buy this thing now Ed, Ed, Few words", "whole")
    bare = dom.parse("<body><div>" + " ".join(f"word{i}" for i in range(20)) + "</div><article></article></body>")
    assert C.main(bare, "NewsArticle", runs=True)[1] == "whole" and C.main(bare, "NewsArticle")[1] == "fallback"
