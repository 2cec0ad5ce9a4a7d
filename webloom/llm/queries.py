"""The registered queries of this package and, where SQL can say it, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types
from pyspark.sql import functions as F

from . import alignment, chat_windows, class_lm, common, cover_tree, decontam, drift, jaccard, langid, licenses, mixing, packing, repeats, token_orc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = common.new_path(spark, "tokens")
    token_orc.write_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_orc.token_digests(spark, path)


def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = langid.held_out(F.col("doc_id"), 7, 2)
    with common.scratch(spark):
        found = class_lm.score(_table(spark, sf_dir, "documents"), F.col("doc_id").isNotNull() & ~held)
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return chat_windows.digests(common.stored(chat_windows.windows(turns.unionByName(planted)), "chat"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    with common.scratch(spark):
        return repeats.Repeats(_table(spark, sf_dir, "documents")).removed(texts=False)


def op5_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    with common.scratch(spark):
        return common.stored(cover_tree.top_k(_table(spark, sf_dir, "embeddings")), "top", keep=True)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    with common.scratch(spark):
        d = mixing.measured(mixing.judged(docs, _table(spark, sf_dir, "labels")), F.col("weight"))
        taken = (F.col("copies") * F.col("size")).cast("long").alias("taken")
        return common.stored(mixing.copies(d, mixing.plan(d)).select("doc_id", "size", "source_size", "target", taken), "taken", keep=True)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row"), "text")
    return licenses.scan(docs).select(F.col("row").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = langid.held_out(F.col("doc_id"), 4, 2)
    model = langid.fit(docs, F.col("doc_id").isNotNull() & ~held)
    found = langid.predict(docs.select(F.col("doc_id").alias("row"), "text"), model).withColumnRenamed("row", "doc_id")
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    with common.scratch(spark):
        return common.stored(decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")), "report", keep=True)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    with common.scratch(spark):
        return jaccard.Join(_table(spark, sf_dir, "documents"), n=4, threshold=0.85).result()


#: The evolved schema of clients, ids from 1, and what stands for the fields that a file lacks.
CLIENTS = drift.with_ids([("client_id", types.LongType()), ("master_id", types.LongType()), ("source", types.StringType()), ("updated_at", types.TimestampNTZType()), ("name", types.StringType()), ("email", types.StringType()), ("city", types.StringType()), ("nation_id", types.LongType()), ("segment", types.StringType()), ("balance", types.DoubleType())])
MISSING = {"nation_id": -1, "source": "none"}
#: How files drift: the fields that swap names, that go and that are narrower.
DRIFT = {"swap": ("name", "email"), "lacking": ("nation_id", "source"), "narrow": {"balance": types.FloatType(), "nation_id": types.IntegerType()}}


def op11_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.new_path(spark, "clients")
    with common.scratch(spark):
        clients = _table(spark, sf_dir, "clients").select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CLIENTS.fields])
        ids = F.col("client_id").cast("string")
        rows, n = drift.ranked(clients, F.crc32(ids.cast("binary")), F.col("client_id"), *[F.col(f.name) for f in CLIENTS.fields[1:]])
        each = 1 + n // 500
        rows = rows.withColumn("file_no", F.floor(F.col("rank") / each)).withColumn("version", drift.version_of(F.col("file_no")))
        drift.write_drifted(rows, folder, CLIENTS, "version", lambda file_no: f"clients-{int(file_no):05d}.parquet", **DRIFT)
        start = drift.rewrite(spark, folder, CLIENTS, MISSING)
        micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', r.updated_at)")
        told = {"updated_at": micros, "balance": F.floor(1048576 * F.col("r.balance"))}
        line = F.concat_ws("|", *[F.coalesce(told.get(f.name, F.col(f"r.{f.name}")).cast("string"), F.lit("?")) for f in CLIENTS.fields])
        with drift.by_field_id(spark):
            found = common.stored(drift.digests(spark, folder, CLIENTS, line, F.coalesce(F.col("r.client_id").cast("string"), F.lit("?"))), "digests")
        name = F.element_at(F.split("path", "/"), -1)
        was = start.select(name.alias("name"), F.array_join("names", ",").alias("start_columns"), F.col("drifted").alias("rewritten"))
        now = drift.footers(spark, folder).select(name.alias("name"), F.array_join("names", ",").alias("columns"))
        file_no = F.regexp_extract("name", "([0-9]+)[.]", 1).cast("long")
        final = found.withColumn("name", name).join(was, "name").join(now, "name").withColumn("file_no", file_no)
        return common.stored(final.select("file_no", drift.version_of(F.col("file_no")).cast("long").alias("version"), "n_rows", "n_nulls", F.col("keys_sha256").alias("ids_sha256"), "rows_sha256", "start_columns", "columns", F.regexp_replace("path", "^file:/*", "/").alias("path"), "rewritten"), "drift", keep=True)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with common.scratch(spark):
        aligned = alignment.Alignment(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
        return common.stored(aligned.report(), "alignment", keep=True)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with common.scratch(spark):
        packed = packing.Packing(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
        return common.stored(packed.pieces(), "packed", keep=True)


QUERIES = {f.__name__: f for f in (op1_token_orc, op2_class_lm, op3_chat_windows, op4_repeats, op5_cover_tree, op6_mixing, op7_licenses, op8_language, op9_decontamination, op10_jaccard, op11_drift, op12_alignment, op13_packing)}

_OP3 = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), n as (
  select *, row_number() over w as nth, sum(cast(ceil(length(text) / 4.0) as bigint) + 4) over w as stop,
    cast(ceil(length(text) / 4.0) as bigint) + 4 as n
  from t window w as (partition by conv_id order by turn nulls first, role, text rows unbounded preceding)
), sys as (
  select conv_id, min(nth) as sys_nth, arg_min(n, nth) as sys_n from n where role = 'system' group by conv_id
), g as (
  select n.*, sys_nth, sys_n, stop - n as start, greatest(384 - coalesce(sys_n, 0), 128) as fresh from n left join sys s on s.conv_id is not distinct from n.conv_id
), p as (
  select *, 2 * (start // fresh) + case when start // fresh = (stop - 1) // fresh then 0 else 1 end as span,
    length(replace(replace(text, '%', '%25'), '<', '%3C')) + length(replace(replace(replace(replace(role, '%', '%25'), '<', '%3C'), '|', '%7C'), '=', '%3D')) + 11 as chars
  from g
), opens as (
  select *, coalesce(sys_nth < nth0 and sys_n + f <= 512, false) as again
  from (select conv_id, span, min(nth) as nth0, min(start) as start0, sum(n) as f, min(sys_nth) as sys_nth, min(sys_n) as sys_n from p group by conv_id, span)
), fmt as (
  select o.conv_id, sum(case when p.span = o.span then p.chars else p.chars + 1 end) as formatted_chars
  from opens o join p on p.conv_id is not distinct from o.conv_id and (p.span = o.span
    or p.nth < o.nth0 and (o.again and p.nth = o.sys_nth
      or p.nth is distinct from o.sys_nth and p.nth >= o.nth0 - 4 and o.start0 - p.start <= least(128, 512 - o.f - case when o.again then o.sys_n else 0 end)))
  group by o.conv_id
), c as (
  select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by nth)) as turns_sha256,
    coalesce(string_agg(text, '' order by nth) filter (role = 'assistant'), '') as loss
  from p group by conv_id
)
select c.conv_id, n_turns, turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256, cast(formatted_chars as bigint) as formatted_chars
from c join fmt on fmt.conv_id is not distinct from c.conv_id
"""

_OP5 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as e from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, v.vec_id as vec_id, cast(list_dot_product(q.e, v.e) as bigint) as score
  from v q join v on v.vec_id <> q.vec_id where q.vec_id % 20 = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20
"""

_OP6 = r"""
with d as (
  select doc_id, source, coalesce(text, '') as text, q,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents
  left join (select doc_id as d, min(quality) as q from labels group by doc_id) on d = doc_id
), k as (
  select doc_id, source, size, -ln((cast('0x' || substr(md5('mix-1|' || coalesce(cast(doc_id as varchar), '') || '|' || md5(text)), 1, 12) as bigint) + 0.5) / 281474976710656.0)
    / (case when length(text) > 0 then greatest(1 - 4 * length(regexp_replace(text, '[\p{L} ]+', '', 'g')) / length(text), 0.05) else 0.05 end * case when q > 0 then 1.0 when q <= 0 then 0.1 else 0.5 end) as key
  from d
), s as (
  select source, sum(size) as source_size, (array[3.0, 1.0, 2.0])[(row_number() over (order by source nulls last) - 1) % 3 + 1] as w
  from k group by source
), l as (
  select *, 1.5 * sum(source_size) over () as total, 2.0 * source_size as most,
    sum(2.0 * source_size) over (order by 2.0 * source_size / w, source nulls last rows unbounded preceding) as capped,
    sum(w) over (order by 2.0 * source_size / w, source nulls last rows between current row and unbounded following) as rest from s
), g as (
  select source, source_size, least(most, w * max((total - (capped - most)) / rest) over ()) as target from l
), e as (
  select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as epochs from g
), o as (
  select k.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size as part,
    sum(size) over (partition by k.source order by key range unbounded preceding) as upto,
    sum(size) over (partition by k.source, key) as here
  from k join e on e.source is not distinct from k.source
)
select doc_id, size, cast(source_size as bigint) as source_size, cast(target as double) as target,
  cast(size * (epochs + case when part > 0 and upto - here / 2 <= part then 1 else 0 end) as bigint) as taken from o
"""

_OP9 = r"""
with d as (
  select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), win as (
  select distinct item_id, array_to_string(w[i : i + 9], ' ') as words, least(len(w), 10) as n
  from (select *, unnest(generate_series(1, greatest(len(w) - 9, 1))) as i from b where len(w) > 0)
), sizes as (select distinct n from win
), p as (
  select rid, n, i, array_to_string(w[i : i + n - 1], ' ') as words
  from (select rid, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d, sizes where len(w) >= n)
), h as (select rid, i, win.n, item_id from p join win on p.n = win.n and p.words = win.words
), c as (select rid, count(distinct x) as n_hit from (select rid, unnest(generate_series(i, i + n - 1)) as x from h) group by rid
), m as (select rid, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from h group by rid)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
from d left join c using (rid) left join m using (rid)
"""

_OP10 = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select distinct doc_id, array_to_string(w[i : i + 3], ' ') as sh
  from (select *, unnest(generate_series(1, greatest(len(w) - 3, 1))) as i from d where len(w) > 0)
), n as (select doc_id, count(*) as n from s group by doc_id
), pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id
), links as (
  select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)
), reach as (
  select doc_id as a, doc_id as b from d union select reach.a, links.b from reach join links on links.a = reach.b
)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id
from d left join n using (doc_id) join (select a as doc_id, min(b) as component_id from reach group by a) m using (doc_id)
"""

ORACLE = {"op10_jaccard": _OP10, "op3_chat_windows": _OP3, "op5_cover_tree": _OP5, "op6_mixing": _OP6, "op9_decontamination": _OP9}
