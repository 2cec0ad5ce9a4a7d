"""Columns of clashing names and one very long text change nothing."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from webloom.llm import class_lm, common, jaccard, licenses, repeats, token_orc

LONG = " ".join(f"word{i % 5000}" for i in range(60_000))
CLASHING = ["row", "shard", "pos", "n_tokens", "ids", "word", "c", "cls", "n", "set", "shingle", "size", "key", "gram", "context", "hash", "text_hash", "start", "end", "at", "d", "q", "a", "b"]


@pytest.fixture(scope="module")
def docs(spark):
    texts = [LONG, LONG + " more", "released under the mit license today", None, "", "a few words of text here", "a few words of text here"]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def tokens(docs):
    path = common.new_path(docs.sparkSession, "tokens")
    token_orc.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_orc.token_digests(docs.sparkSession, path)


RUNS = {
    "tokens": tokens,
    "class_lm": lambda d: class_lm.score(d, F.col("doc_id") % 2 == 0),
    "repeats": lambda d: repeats.Repeats(d).removed(texts=False),
    "jaccard": lambda d: jaccard.Join(d).result(),
    "licenses": lambda d: licenses.scan(d.withColumn("row", F.col("doc_id"))),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_other_columns(docs, name):
    clashing = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])
    plain, odd = RUNS[name](docs), RUNS[name](clashing)
    rows = lambda df: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.collect())
    assert rows(odd.select(*plain.columns)) == rows(plain)
    assert plain.count() == 7
