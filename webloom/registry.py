"""Registered queries over the driver's tables, each with its oracle in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir), under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(map(sql_text, values)) + "]"


def sql_any(column: str, needles: list[str]) -> str:
    """Whether a text holds any of the needles."""
    return "(" + " or ".join(f"contains({column}, {sql_text(n)})" for n in needles) + ")"


def sql_host(url: str) -> str:
    return f"lower(regexp_extract({url}, '^https?://([^/?#:]+)', 1))"


def sql_path(url: str) -> str:
    return f"regexp_extract({url}, '^https?://[^/?#]+([^?#]*)', 1)"


def sql_words(text: str) -> str:
    return rf"len(list_filter(regexp_split_to_array({text}, '\s+'), lambda w: w <> ''))"
