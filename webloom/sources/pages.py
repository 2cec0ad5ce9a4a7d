"""Page scan: (page_id, url, html) to one row of everything read from the page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import quality as Q
from ..functions import url as U
from ..operators import store
from . import content as C
from . import dom

PARSED = """page_id long, url string, title string, meta_description string, meta_keywords string, canonical_url string,
site_name string, og_title string, og_description string, og_image string, author string, published_at string, language string,
headings array<struct<level:string,text:string>>, links array<struct<url:string,text:string>>,
images array<struct<src:string,alt:string,title:string>>, code_blocks array<struct<language:string,code:string>>,
embedded_sources array<struct<source_type:string,content:string>>, embedded_state_json string,
clean_content string, markdown string"""
NAMES = re.findall(r"(?:^|,\s)(\w+) (?=long|string|array)", PARSED)


def _content(root, base: str, line_aware: bool, page_title: str, pictures: list, kind: str, host: str) -> str:
    """The page's clean text: main content, else linked data, else the state of an application, else the description."""
    main = C.main(root, kind, host)[0]
    text = (dom.linked_data(root) if dom.words(main) < 10 else None) or main
    if dom.words(text) < 50:
        text = dom.state_text(root) or text
    clean = dom.post_cleaned(text, line_aware)
    description = dom.meta(root, "og:description") if dom.words(clean) < 50 else None
    return dom.with_image_context(description or clean, pictures, page_title)


def _image(root, base: str) -> str | None:
    found = dom.meta(root, "og:image")
    return dom._absolute(base, found) if found else None


#: How each field is read from a parsed page and its address; clean_content has a function of its own.
READERS = {
    "title": lambda root, base: dom.title(root),
    "meta_description": lambda root, base: dom.meta(root, "description") or "",
    "meta_keywords": lambda root, base: dom.meta(root, "keywords") or "",
    "canonical_url": dom.canonical,
    "site_name": lambda root, base: dom.meta(root, "og:site_name"),
    "og_title": lambda root, base: dom.meta(root, "og:title"),
    "og_description": lambda root, base: dom.meta(root, "og:description"),
    "og_image": _image,
    "author": lambda root, base: dom.meta(root, "author", "article:author"),
    "published_at": lambda root, base: dom.meta(root, "article:published_time"),
    "language": lambda root, base: dom.language(root),
    "headings": lambda root, base: dom.headings(root),
    "links": dom.content_links,
    "images": dom.images,
    "code_blocks": dom.code_blocks,
    "embedded_sources": lambda root, base: dom.embedded_sources(root),
    "embedded_state_json": lambda root, base: dom.state_json(root),
    "markdown": lambda root, base: dom.to_markdown(root),
}


def read_page(url: str, html: str, line_aware: bool = False, fields: list[str] | None = None, kind: str | None = None, **parsing: str) -> dict:
    """What dom and content read from one page, or the named fields of it; an empty page has empty lists and texts."""
    root, base = dom.parse(html or "", **parsing), url or ""
    wanted = NAMES[2:] if fields is None else fields
    out = {f: READERS[f](root, base) for f in wanted if f in READERS}
    if "clean_content" in wanted:
        page_title = out["title"] if "title" in out else dom.title(root)
        pictures = out["images"] if "images" in out else dom.images(root, base)
        out["clean_content"] = _content(root, base, line_aware, page_title, pictures, kind or "Unknown", urlsplit(base).hostname or "")
    return out


#: Pages of a batch that are read, with all that is read from them, before they are handed on.
AT_ONCE = 64


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    for b in batches:
        for low in range(0, b.num_rows, AT_ONCE):
            yield b.slice(low, AT_ONCE).to_pylist()


def parsed(pages: DataFrame, fields: list[str] | None = None, **parsing: str) -> DataFrame:
    """One parse of each page, in Arrow batches (a small table is dealt to all cores first); with fields, only those are read; `parsing`: as of dom.parse."""
    kinds = dict(re.findall(r"(?:^|,\s)(\w+) (long|string|array<(?:string|struct<.*?>)>)(?=,|$)", PARSED))
    names = ["page_id", "url", *(f for f in NAMES[2:] if fields is None or f in fields)]

    ddl = ", ".join(f"{n} {kinds[n]}" for n in names)
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _slices(batches):
            rows = [{"page_id": r["page_id"], "url": r["url"], **read_page(r["url"] or "", r["html"] or "", fields=names[2:], kind=r["kind"], **parsing)} for r in some]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    kind = Q.content_kind(F.col("url"), F.col("html")) if "clean_content" in names else F.lit(None).cast("string")
    return store.spread(pages.select("page_id", "url", "html", kind.alias("kind"))).mapInArrow(run, ddl)


#: The passes that look for a page's text, by name; each gives a text or nothing.
PASSES = {"heuristic": C.heuristic, "book": C.book, "preformatted": C.preformatted, "fallback": C.fallback, "text_only": C.text_only}


def contents(pages: DataFrame, passes: list[str] | None = None, selectors: list[str] | None = None, runs: bool = False) -> DataFrame:
    """page_id, content and found_by (the pass that found it), the texts of single passes, and how many nodes each of the selectors finds.

    With `runs`, runs of like placeholders stay and count, and content is as C.main has it with them.
    """
    names = list(PASSES) if passes is None else passes
    selectors = selectors or []
    schema = "page_id long, content string, found_by string" + "".join(f", {n} string" for n in names) + ", selected array<int>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, host, kind, html in zip(b["page_id"], b["host"], b["kind"], b["html"], strict=True):
                root = dom.parse(html or "")
                index = C.Index(root, runs=runs)
                found = ((html or "")[:50_000], "raw") if kind == "ApiResponse" else C.main(root, kind or "Unknown", host or "", runs)
                rows.append((i, *found, *[PASSES[n](index) for n in names], [len(index.select(s)) for s in selectors]))
            yield pd.DataFrame(rows, columns=["page_id", "content", "found_by", *names, "selected"])

    return store.spread(pages.select("page_id", U.host(F.col("url")).alias("host"), Q.content_kind(F.col("url"), F.col("html")).alias("kind"), "html")).mapInPandas(run, schema)


#: Fields that scored() and extraction read.
SCORED = ["title", "meta_description", "author", "published_at", "headings", "code_blocks", "clean_content", "markdown"]


def scored(rows: DataFrame) -> DataFrame:
    """Parsed pages with counts, quality, reading time and domain; column expressions only.

    A page without clean content falls back to its markdown, at a fixed low score.
    """
    bare = (F.trim("clean_content") == "") & (F.trim("markdown") != "")
    rows = rows.withColumn("fallback", bare).withColumn("clean_content", F.when(bare, F.col("markdown")).otherwise(F.col("clean_content")))
    w = F.size(F.filter(F.split("clean_content", "(?U)\\s+"), lambda x: x != "")).cast("long")
    r = rows.withColumn("word_count", w)
    r = r.withColumns(
        {
            "extraction_score": F.when(F.col("fallback"), 0.3).otherwise(Q.extraction_score(F.col("word_count"), F.col("published_at"), F.size("code_blocks"), F.size("headings"))),
            "reading_minutes": Q.reading_minutes(F.col("word_count")),
            "domain": U.domain(F.col("url")),
            "page_type": Q.page_type(F.col("url"), F.col("title"), F.col("clean_content"), F.size("headings"), F.col("word_count"), F.col("published_at")),
        }
    )
    warn = [F.when(F.col("fallback"), "fallback_scraper_used"), F.when(F.col("word_count") < 50, "short_content"), F.when(F.col("extraction_score") < 0.4, "low_extraction_score"), F.when(Q.is_auth_wall(F.col("clean_content")), "content_restricted")]
    return r.withColumn("warnings", F.filter(F.array(*warn), lambda x: x.isNotNull())).drop("fallback")


def fetched(urls: DataFrame, pages: DataFrame, max_chars: int = 10_000) -> DataFrame:
    """Pages of a list of urls(url), as one batch: every URL has a row, with success and why not."""
    got = scored(parsed(pages.join(urls.select("url").distinct(), "url", "left_semi"), SCORED))
    body = F.col("word_count") <= 3
    bare = (F.size("code_blocks") == 0) & (F.size("headings") == 0)
    both = urls.select("url").join(got, "url", "left")
    ok = F.col("title").isNotNull() & ~(body & bare)
    over = F.octet_length("clean_content") > max_chars
    return both.select(
        "url",
        F.coalesce(ok, F.lit(False)).alias("success"),
        F.when(F.col("title").isNull(), "not_found").when(~ok, "no_content").alias("failure_reason"),
        "title",
        F.when(over, F.substring("clean_content", 1, max_chars)).otherwise(F.col("clean_content")).alias("clean_content"),
        F.coalesce(over, F.lit(False)).alias("truncated"),
        "word_count",
        F.when(over, F.array_union("warnings", F.array(F.lit("content_truncated")))).otherwise(F.col("warnings")).alias("warnings"),
    )
