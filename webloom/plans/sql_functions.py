"""Functions of the engine for SQL, under the prefix web_: temporary SQL functions, no Python on the executors."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "web_clean_text(t string) returns string": r"trim(regexp_replace(t, '(?U)\\s+', ' '))",
    "web_words(t string) returns bigint": r"cast(size(filter(split(coalesce(t, ''), '(?U)\\s+'), w -> w <> '')) as bigint)",
    "web_tokens(t string) returns array<string>": r"filter(split(lower(t), '[^\\p{IsAlphabetic}\\p{N}]+'), w -> octet_length(w) > 2)",
    "web_domain(u string) returns string": "coalesce(lower(try_parse_url(u, 'HOST')), 'unknown')",
    "web_cosine(a array<float>, b array<float>) returns double": "if(size(a) <> size(b), 0D, coalesce(try_divide(aggregate(zip_with(a, b, (x, y) -> double(x) * y), 0D, (s, v) -> s + v), sqrt(aggregate(a, 0D, (s, v) -> s + double(v) * v)) * sqrt(aggregate(b, 0D, (s, v) -> s + double(v) * v))), 0D))",
    "web_band(s double) returns string": "case when s >= 0.9 then 'Exact' when s >= 0.7 then 'High' when s >= 0.5 then 'Partial' else 'Low' end",
}


def register(spark: SparkSession) -> list[str]:
    """Registers all in the session; returns their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {head} return {body}")
    return [head.partition("(")[0] for head in FUNCTIONS]
