"""Shaving without a model: within the row, and no likeness by a clash of hashes."""

from pyspark.sql import functions as F

from webloom.operators import relevance as R


def test_shaved_without_a_shuffle(spark):
    long_ = " ".join(["alpha beta"] * 100 + ["delta epsilon"] * 150)
    d = R.shaved(spark.createDataFrame([(1, long_), (1, long_), (2, None), (3, "")], "id long, text string"), "delta epsilon", 0.9)
    assert "hashpartitioning" not in d._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.kept, r.total) for r in d.collect() if r.id != 2) == [(1, 2, 4), (1, 2, 4), (3, None, None)]


def test_likeness_is_the_cosine_of_embedded_vectors(spark):
    from webloom.functions import quality as Q

    rows = spark.createDataFrame([("the spark reads the table of the pages",), ("",), (None,), ("zwei drei vier",)], "text string")
    got = rows.select(R.likeness(F.col("text"), "spark table the the", spark=spark).alias("a"), F.round(Q.cosine(R.embedded(F.coalesce("text", F.lit(""))), R.embedded(F.lit("spark table the the"))), 6).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]
    assert got[0].a > 0


def test_gate_takes_no_clash_of_hashes_for_likeness(spark):
    hashed = F.pmod(F.xxhash64("w"), F.lit(R.DIMENSIONS))
    words = spark.range(2000).select(F.concat(F.lit("word"), "id").alias("w")).union(spark.createDataFrame([("zzzq",)], "w string"))
    at = {r.w: r.h for r in words.select("w", hashed.alias("h")).collect()}
    clash = next(w for w, h in at.items() if h == at["zzzq"] and w != "zzzq")
    page = spark.createDataFrame([("a", f"{clash} " * 250, 250, [])], "url string, clean_content string, word_count long, warnings array<string>")
    got = R.gated(page, "zzzq").first()
    assert got.word_count == 150
    assert got.warnings == ["semantic_shave: kept 1/2 chunks (250 → 150 words)"]


def test_a_memory_entry_splits_its_summary_once(spark):
    from webloom.operators import memory, relevance

    rows = spark.createDataFrame([(1, "the cat and the dog"), (2, ""), (3, None)], "id long, text string")
    counts = rows.select("id", relevance.embedded(F.col("text")).alias("v"))
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(array(transform(" in plan  # bound to a variable before the dimensions are gone through
    got = {r.id: r.v for r in counts.collect()}
    assert sum(got[1]) == 5 and len(got[1]) == 64 and max(got[1]) >= 2 and set(got[2]) == {0.0}
    long = spark.createDataFrame([("x" * 15_001,), ("x" * 15_000,), (None,)], "r string").select(memory._limited(F.col("r")).alias("r"))
    assert [r.r and (len(r.r), "_truncated" in r.r) for r in long.collect()] == [(15_000 + len('{"content":"","_truncated":true}'), True), (15_000, False), None]
