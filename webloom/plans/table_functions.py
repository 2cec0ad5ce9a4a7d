"""Table functions of the engine for SQL: rows of a text or page, by lateral join.

    select doc_id, c.* from documents, lateral web_chunks(text, 200, 100) c
    select page_id, s.* from pages, lateral web_select(html, 'article p') s

Each checks its arguments when the query is analyzed, before any row is read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, IntegralType, NullType, StringType, StructType


def _text(name: str, arg: AnalyzeArgument) -> None:
    if not isinstance(arg.dataType, StringType | NullType):
        raise ValueError(f"{name} must be text, not {arg.dataType.simpleString()}")


def _positive(name: str, arg: AnalyzeArgument | None) -> None:
    if arg is not None and (not isinstance(arg.dataType, IntegralType) or not arg.isConstantExpression or arg.value is None or arg.value < 1):
        raise ValueError(f"{name} must be a positive constant")


class Chunks:
    """chunk (from 0) and text: overlapping runs of words; a short text is one chunk, as it is; null and blank texts have none."""

    @staticmethod
    def analyze(text: AnalyzeArgument, window: AnalyzeArgument = None, stride: AnalyzeArgument = None) -> AnalyzeResult:
        _text("text", text)
        _positive("window", window)
        _positive("stride", stride)
        return AnalyzeResult(StructType().add("chunk", IntegerType()).add("text", StringType()))

    def eval(self, text, window=200, stride=100) -> Iterator[tuple]:
        words = (text or "").split()
        if not words:
            return
        if len(words) <= window:
            yield 0, text
            return
        for i in range(-(-(len(words) - window) // stride) + 1):
            yield i, " ".join(words[i * stride : i * stride + window])


class Select:
    """nth (from 0), tag and text of the elements of a page that a selector finds."""

    @staticmethod
    def analyze(html: AnalyzeArgument, selector: AnalyzeArgument) -> AnalyzeResult:
        _text("html", html)
        if not selector.isConstantExpression or not isinstance(selector.value, str) or not selector.value.strip():
            raise ValueError("selector must be a constant that is not blank")
        return AnalyzeResult(StructType().add("nth", IntegerType()).add("tag", StringType()).add("text", StringType()))

    def eval(self, html, selector) -> Iterator[tuple]:
        from ..sources import content, dom

        index = content.Index(dom.parse(html or ""))
        for i, node in enumerate(index.select(selector)):
            yield i, node.tag, " ".join(index.text(node, "").split())


class Links:
    """nth (from 0), url and text of the links of a page's content."""

    @staticmethod
    def analyze(url: AnalyzeArgument, html: AnalyzeArgument) -> AnalyzeResult:
        _text("url", url)
        _text("html", html)
        return AnalyzeResult(StructType().add("nth", IntegerType()).add("url", StringType()).add("text", StringType()))

    def eval(self, url, html) -> Iterator[tuple]:
        from ..sources import dom

        for i, link in enumerate(dom.content_links(dom.parse(html or ""), url or "")):
            yield i, link["url"], link["text"]


FUNCTIONS = {"web_chunks": Chunks, "web_select": Select, "web_links": Links}


def register(spark: SparkSession) -> list[str]:
    """Registers all in the session; returns their names."""
    for name, handler in FUNCTIONS.items():
        spark.udtf.register(name, udtf(handler))
    return list(FUNCTIONS)
