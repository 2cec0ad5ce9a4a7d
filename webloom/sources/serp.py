"""Result pages of search engines: (engine, html) to ranked rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U
from . import dom

SCHEMA = "serp_id long, engine string, rank int, title string, href string, snippet string"


def _inside(n: dom.Node, tag: str) -> dom.Node | None:
    while n is not None and n.tag != tag:
        n = n.parent
    return n


def _snippet(n: dom.Node, *classes: str) -> str:
    return next((x.text() for c in classes for x in n.walk() if c in x.classes() and x.text()), "")


def results(engine: str, html: str) -> Iterator[tuple[str, str, str]]:
    """(title, href, snippet) in order."""
    root = dom.parse(html)
    if engine == "google":
        boxes = [n for n in root.all("div") if "MjjYud" in n.classes()] or [n for n in root.all("div") if "g" in n.classes()]
        for box in boxes:
            a = next((a for a in box.all("a") if a.first("h3") is not None and a.get("href")), None)
            if a is not None:
                yield a.first("h3").text(), a.get("href"), _snippet(box, "VwiC3b", "IsZvec", "st")
    elif engine == "bing":
        for box in (n for n in root.all("li") if "b_algo" in n.classes()):
            h2 = box.first("h2")
            a = h2.first("a") if h2 is not None else None
            caption = next((n for n in box.all("div") if "b_caption" in n.classes()), None)
            p = caption.first("p") if caption is not None else None
            if a is not None and a.get("href"):
                yield a.text(), a.get("href"), p.text() if p is not None else ""
    elif engine == "duckduckgo":
        for box in (n for n in root.all("div") if "results_links" in n.classes()):
            a = next((a for a in box.all("a") if "result__a" in a.classes() and a.get("href")), None)
            if a is not None:
                yield a.text(), a.get("href"), _snippet(box, "result__snippet")
    elif engine == "brave":
        main = root.first("main")
        for a in main.all("a") if main is not None else []:
            if a.first("h3") is not None and a.get("href"):
                box = a.parent
                yield a.first("h3").text(), a.get("href"), _snippet(box, "snippet-description") if box is not None else ""


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(i, e, k, *r) for i, e, h in zip(b["serp_id"], b["engine"], b["html"], strict=True) for k, r in enumerate(results(e or "", h or ""))]
        yield pd.DataFrame(rows, columns=["serp_id", "engine", "rank", "title", "href", "snippet"]).astype({"serp_id": "int64", "rank": "int32"})


def parsed(serps: DataFrame, per_engine: int = 10) -> DataFrame:
    """serps(serp_id, engine, html) to url, title, content, published_at, domain, source_type, breadcrumbs, in each engine's order."""
    rows = serps.select("serp_id", "engine", "html").mapInPandas(_batches, SCHEMA)
    href, engine = F.col("href"), F.col("engine")
    url = F.when(engine == "google", U.unwrapped_google(href)).when(engine == "bing", U.unwrapped_bing(href)).when(engine == "duckduckgo", U.unwrapped_duckduckgo(href)).otherwise(F.when(U.is_http(href), href))
    rows = rows.withColumn("url", url).where(U.is_http(F.col("url")))
    rows = rows.where(~((engine == "google") & F.endswith(U.host(F.col("url")), F.lit("google.com"))))
    cut = T.date_prefix(F.col("snippet"))
    rows = rows.where(F.col("rank") < per_engine)
    return rows.select("serp_id", "engine", "rank", "url", "title", cut["rest"].alias("content"), F.coalesce(cut["date"], T.published_at(F.col("snippet"))).alias("published_at"), U.host(F.col("url")).alias("domain"), U.source_type(F.col("url")).alias("source_type"), U.breadcrumbs(F.col("url")).alias("breadcrumbs"))


