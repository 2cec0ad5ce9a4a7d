"""Proxy lists: text lines to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as U
from ..functions.text import first_match

# Spellings of kinds of proxy.
KINDS = {"http": "http", "https": "https", "socks4": "socks4", "sock4": "socks4", "socks5": "socks5", "sock5": "socks5", "socks": "socks5"}


def kind(name: Column) -> Column:
    n = F.lower(F.trim(name))
    return first_match([(n == k, v) for k, v in KINDS.items()], F.lit(None).cast("string"))


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are computed once for each row, however often they are used further on.

    Spark writes an expression anew wherever its column is used in a condition
    or taken apart; the columns of a generator it does not.
    """
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def lines(rows: DataFrame, scheme: str = "auto") -> DataFrame:
    """rows(value), a line each, as url, scheme, host, port, priority, supported; comments, blank and unreadable lines go."""
    p = _once(rows.select("value"), v=F.trim(F.regexp_replace("value", "#.*$", "")))
    bare = F.regexp_replace(F.regexp_replace("v", "^[A-Za-z0-9]+://", ""), "^[^@]*@", "")
    p = _once(p, own=F.lower(F.regexp_extract("v", "^([A-Za-z0-9]+)://", 1)), bare=bare)
    p = _once(p, at=U.host_port(F.col("bare"))).where(F.col("at").isNotNull())
    guessed = U.scheme_by_port(F.col("at.port")) if scheme == "auto" else F.lit(scheme)
    p = _once(p, scheme=F.when(F.col("own") != "", kind(F.col("own"))).otherwise(guessed)).where(F.col("scheme").isNotNull())
    url = F.when(F.col("own") != "", F.col("v")).otherwise(F.concat("scheme", F.lit("://"), "v"))
    return p.select(url.alias("url"), "scheme", "at.host", "at.port", F.when(F.col("scheme") == "socks5", 3).when(F.col("scheme") == "socks4", 0).otherwise(4).alias("priority"), (F.col("scheme") != "socks4").alias("supported"))


def listed(rows: DataFrame, wanted: str | None = None, limit: int | None = None) -> DataFrame:
    """Different proxies of lines(), of one kind if it is named, by address."""
    p = lines(rows)
    if wanted:
        # an address has one kind, so others need not be compared
        p = p.where(F.col("scheme") == wanted)
    p = p.dropDuplicates(["url"])
    return p.orderBy("url").limit(limit) if limit else p
