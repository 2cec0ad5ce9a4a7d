"""Registered queries of this package against their SQL, and the pipeline's stages on odd tables."""

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from webloom.llm import langid, licenses, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def rows_of(df, columns):
    return sorted(tuple(plain(v) for v in r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = db.sql(queries.ORACLE[name])
    assert sorted(want.columns) == columns
    assert rows_of(df, columns) == sorted(tuple(plain(v) for v in x) for x in want.select(*[f'"{c}"' for c in columns]).fetchall())


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')"


def test_exact_phrases_equal_sql(spark, db):
    """What op7 owes exactly: words, places of phrases, their labels."""
    words = _WORDS.format(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    places = " union all ".join(f"select doc_id, i, '{label}' as label from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d) where w[i : i + {len(p.split()) - 1}] = {p.split()}" for p, label in licenses.PHRASES.items())
    sql = f"with d as (select doc_id, {words} as w from documents), p as ({places}) select d.doc_id, len(w) as n_words, count(i) as n_base, min(i) - 1 as first_word, max(i) - 1 as last_word, coalesce(string_agg(distinct label, ',' order by label), '') as base_labels from d left join p on p.doc_id = d.doc_id group by d.doc_id, w"
    columns = ["base_labels", "doc_id", "first_word", "last_word", "n_base", "n_words"]
    got = rows_of(queries.op7_licenses(spark, SF), columns)
    assert got == sorted(tuple(plain(v) for v in x) for x in db.sql(sql).select(*columns).fetchall())
    assert any(x[0] for x in got)


def test_base_score_equals_sql(spark, db):
    """What op2 owes exactly; crc32 is no function of the SQL, so the held out rows come from the query."""
    df = queries.op2_class_lm(spark, SF)
    rows = df.collect()
    db.execute("create or replace table held (doc_id bigint, held_out boolean)")
    db.executemany("insert into held values (?, ?)", [(r.doc_id, r.held_out) for r in rows])
    sql = f"""with d as (select doc_id, held_out, list_append({_WORDS.format(r"[^\x20\x09-\x0D]+")}, chr(10)) as w from documents join held using (doc_id)),
      c as (select w, count(*) as c from (select unnest(w) as w from d where not held_out) group by w), s as (select sum(c) as n, count(*) as v from c), t as (select doc_id, unnest(w) as w from d)
      select doc_id, count(*) as n_tokens, count(c) as n_known, any_value(n)::bigint as train_tokens, sum(log10((coalesce(c, 0) + 1) / (n + v + 1))) as base from t left join c using (w), s group by doc_id"""
    want = {x[0]: x[1:] for x in db.sql(sql).fetchall()}
    assert {r.doc_id for r in rows} == set(want) and len(rows) == len(want)
    for r in rows:
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and abs(r.base_score - base) < 1e-6 * max(1, -base)
    # the model tells texts that it has not seen better than the base does
    held = [r for r in rows if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op8_language(spark, SF).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out and lang is not null").where(F.col("text").rlike("\\p{L}")).collect()
    right = sum(r.lang == r.lang_pred for r in got)
    assert len(got) > 30 and right >= 0.95 * len(got)


def test_language_of_odd_tables(spark):
    texts = [("the and of to in is that for it with as was on", "en"), ("der die und das nicht ist ein zu mit auf für", "de")]
    rows = [(i, texts[i % 2][0], texts[i % 2][1]) for i in range(200)] + [(1000 + i, f"x{i} y", f"dirty{i:03}") for i in range(300)]
    rows += [(5, texts[1][0], "de"), (5, texts[1][0], "de"), (2000, "the and of to " * 20_000, "en"), (2001, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("row", "told", "lang_pred", "score", "_text")})
    model = langid.fit(df, F.lit(True), sample=256, languages=2)
    assert model.family.classes and {c for m in model.within.values() for c in m.classes} == {"de", "en"}  # those with the most rows
    got = langid.predict(df.select(F.struct("doc_id", "lang").alias("row"), "text", "score"), model).collect()
    assert len(got) == len(rows) and all(r.lang_pred == r.row.lang for r in got if r.row.lang in ("en", "de"))
    assert {r.lang_pred for r in got if r.row.doc_id == 2001} == {"und"}
    same = langid.fit(spark.createDataFrame([(i, "ab cd", v) for i, v in enumerate("zyx" * 20)], "doc_id long, text string, lang string"), F.lit(True))
    (tie,) = langid.predict(spark.createDataFrame([(1, "!? ab")], "row int, text string"), same).collect()
    assert tie.lang_pred in ("x", "y", "z") and 0 <= tie.score <= 1


def test_licenses_of_odd_tables(spark):
    long = "word " * 100_000 + "released under the mit license " + "word " * 100_000
    df = spark.createDataFrame([(1, long), (2, "MIT license"), (2, "MIT license"), (None, "apache license")], "row int, text string").withColumns({c: F.lit(0) for c in ("_text", "score", "spans")})
    got = licenses.scan(df).collect()
    (whole,) = [r for r in got if r.row == 1]
    assert (whole.n_words, whole.n_base, whole.first_word) == (200_005, 1, 100_003) and len(whole.spans) == 1
    assert sum(r.row == 2 and r.labels == "mit" for r in got) == 2 and [r.labels for r in got if r.row is None] == ["apache"]


KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("case", ["odd", "empty"])
def test_pipeline_on_odd_tables(spark, tmp_path, case):
    """Nulls in any column, empty and repeated rows, a long text, columns with names that stages use."""
    line = "this is the text of a document that the language machines can tell from others because it is long enough"
    rows = [(i, f"{line} and its number is {i * 7919}", "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "", "en", "s1", 0), (102, "12 !?", "en", None, 3), (None, f"{line} without a number", "en", "s1", 5), (7, rows[7][1], "en", "s1", 1), (7, rows[7][1], "en", "s1", 1), (103, "é", None, "s2", 1), (104, " ".join(f"w{i}" for i in range(30_000)) + line, "en", "s0", 9)]
    docs = spark.createDataFrame(rows if case == "odd" else [], KIND).withColumns({c: F.lit("clash") for c in ("row", "k", "d", "h", "key", "size", "weight", "set", "told", "bucket", "w", "nth")})
    spark.createDataFrame([(1, f"{line} and its"), (None, None)] if case == "odd" else [], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame, seen = docs, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        path = str(tmp_path / f"stage{k}")
        stage(spark, frame, str(tmp_path)).write.parquet(path)
        frame = spark.read.parquet(path)
        assert frame.columns == docs.columns
        seen.append(frame.count())
    out = corpus_pipeline.tokens(spark, frame, str(tmp_path)).collect()
    assert len(out) == seen[-1]
    if case == "odd":
        kept = {r.doc_id for r in spark.read.parquet(str(tmp_path / "stage0")).collect()}
        assert not {100, 101, 102} & kept and {1, 7, None} <= kept
        assert seen[2] < seen[1] and out
    else:
        assert seen == [0] * 5
