"""From raw documents to token files, one stage after the other.

Each stage takes the documents that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import common, decontam, jaccard, langid, mixing, token_orc

#: Predictions below this score are rejected, as are texts without a letter.
LEAST_SCORE = 0.3


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: with a letter, and a prediction that is not a guess.  It becomes their `lang`."""
    model = langid.fit(docs, F.col("doc_id").isNotNull() & ~langid.held_out(F.col("doc_id"), 4, 2))
    told = docs.select(F.struct(*docs.columns).alias("row"), langid.predicted(spark, F.col("text"), model).alias("told"))
    kept = told.where((F.col("told.lang_pred") != "und") & (F.col("told.score") >= LEAST_SCORE))
    return kept.select(F.col("row").withField("lang", F.col("told.lang_pred")).alias("row")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, the one of the smallest doc_id.

    Linked: sets of five-word shingles with a similarity of 0.8 or more.
    """
    with common.scratch(spark):
        return jaccard.one_of_each(docs, n=5, threshold=0.8)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    with common.scratch(spark):
        return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    with common.scratch(spark):
        return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files; doc_id, start, n_tokens and ids_crc32 as read from them."""
    import public_tokenizers

    path = common.new_path(spark, "tokens")
    token_orc.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_orc.token_digests(spark, path)


STAGES = [
    ("language ID", languages),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing sources", mixture),
    ("token-ID output", tokens),
]
#: Linear machines and hashed draws are no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage wrote goes once the next has written its own."""
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"), 250)
        if hasattr(before, "stored_at"):
            common.spent(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
