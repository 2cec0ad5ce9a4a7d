"""Registered queries of whole families of functions: each table row goes through all of a family."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables
from .functions import fields as X
from .functions import quality as Q
from .functions import text as T
from .functions import url as U
from .operators import crawl as C
from .operators import memory as M
from .operators import research as D
from .operators import search as S
from .operators import state as ST
from .operators import store
from .registry import query, sql_any, sql_host, sql_list, sql_path, sql_text, sql_words, table
from .sources import cache, proxies
from .sources import pages as P
from .streaming import events as EV

NOW = dt.datetime(2024, 2, 1)
_NOW = "timestamp '2024-02-01 00:00:00'"


def _each(df: DataFrame, *columns, name: str = "i", value: str = "u") -> DataFrame:
    """df with a row for each of the columns, numbered from 0."""
    return df.select("*", F.posexplode(F.array(*columns)).alias(name, value))


def _sql_each(rows: str, *values: str, name: str = "i", value: str = "u") -> str:
    return f"(select *, unnest([{', '.join(values)}]) as {value}, unnest(range({len(values)})) as {name} from ({rows}))"


# -- URLs

_HREFS = ["https://a.example/x", "//cdn.example/y", "/rooted/z", "rel/page", "./here", "?q=1", "#part", "mailto:a@b.example", "javascript:void(0)", ""]


@query(
    "select page_id, i, case i when 0 then 'https://a.example/x' when 1 then scheme || '//cdn.example/y' when 2 then origin || '/rooted/z' when 3 then folder || 'rel/page' when 4 then folder || 'here' when 5 then regexp_extract(url, '^[^?#]*') || '?q=1' end as target from ("
    r"select page_id, url, regexp_extract(url, '^([a-z]+:)//', 1) as scheme, regexp_extract(url, '^[a-z]+://[^/?#]+') as origin, regexp_extract(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+[^?#]*'), '^([a-z]+://[^/?#]+)$', '\1/'), '^(.*/)[^/]*$', 1) as folder from pages), range(10) t(i)"
)
def href_targets(spark, sf_dir):
    p = _each(table(spark, sf_dir, "pages").select("page_id", "url"), *map(F.lit, _HREFS), value="href")
    return p.select("page_id", F.col("i").cast("long").alias("i"), U.resolved(F.col("url"), F.col("href")).alias("target"))


_REPOSITORY = _sql_each(
    "select page_id, cast(page_id as varchar) as p, url from pages",
    "'https://github.com/o' || p || '/r/blob/main/src/f' || p || '.py'",
    "'http://www.github.com/o/r' || p || '/blob/v1/a.md'",
    "'https://github.com/o' || p || '/r'",
    "'https://github.com/o/r/issues?x=' || p || '#c'",
    "'https://github.com/o/r/wiki?plain=1'",
    "url",
)


@query(
    rf"""select page_id, i, coalesce(case when regexp_matches(u, '^https?://(?:www\.)?github\.com/[^/]+/[^/]+/blob/.*$') then regexp_replace(u, '^(https?://)(?:www\.)?github\.com(/[^/]+/[^/]+)/blob(/.*)$', '\1raw.githubusercontent.com\2\3') end,
  case when regexp_matches(u, '^https?://github\.com/[^/?#]+/[^/?#]+$') then regexp_replace(u, '^https?://github\.com/([^/?#]+)/([^/?#]+)$', 'https://raw.githubusercontent.com/\1/\2/HEAD/README.md') end) as raw,
  case when {sql_host('u')} = 'github.com' and not contains({sql_path('u')}, '/blob/') and not regexp_matches(u, '[?&]plain=1(&|#|$)') then regexp_extract(u, '^[^#]*') || case when contains(regexp_extract(u, '^[^#]*'), '?') then '&' else '?' end || 'plain=1' || regexp_extract(u, '#.*$') end as plain from {_REPOSITORY}"""
)
def repository_urls(spark, sf_dir):
    p, at = F.col("page_id").cast("string"), lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    some = [at("https://github.com/o", p, "/r/blob/main/src/f", p, ".py"), at("http://www.github.com/o/r", p, "/blob/v1/a.md"), at("https://github.com/o", p, "/r"), at("https://github.com/o/r/issues?x=", p, "#c"), F.lit("https://github.com/o/r/wiki?plain=1"), F.col("url")]
    u = _each(table(spark, sf_dir, "pages").select("page_id", "url"), *some)
    return u.select("page_id", F.col("i").cast("long").alias("i"), U.clean_content_url(F.col("u")).alias("raw"), U.plain_view_url(F.col("u")).alias("plain"))


_TAILS = ["/a.rs", "/b.PY", "/c.md?x=1", "/tutorial/x", "/docs/app.mjs", "/data.csv#t", "/p.png", "/"]
_SITES = ["https://docs.rs/x", "https://docs.python.org/3/", "https://www.linkedin.com/in/a", "https://x.com/a", "https://a.b.x.com/a", "https://doc.example/a.go", "https://stats.doubleclick.net/p.gif", "https://www.google-analytics.com/collect"]
_U = "regexp_extract(url, '^https?://[^/?#]+')"
_KINDS = _sql_each("select page_id, url from pages", "url", *[f"{_U} || {sql_text(t)}" for t in _TAILS], *map(sql_text, _SITES))
_EXT = rf"lower(regexp_extract({sql_path('u')}, '\.([A-Za-z0-9]+)$', 1))"
_LANG = "case e " + " ".join(f"when '{k}' then '{v}'" for k, v in tables.CODE_EXTENSIONS.items()) + " end"
_BROWSER = f"{sql_any('h', tables.BROWSER_HOSTS)} or h = '{tables.BROWSER_DOMAIN}' or ends_with(h, '.{tables.BROWSER_DOMAIN}')"


@query(
    rf"""select page_id, i, {_LANG} as language, e in ({', '.join(map(sql_text, tables.RAW_EXTENSIONS))}) as raw, replace(h, '.', '_') as own_key,
  case when contains(above, '.') and above <> h then replace(above, '.', '_') end as parent_key,
  {sql_any('h', tables.TUTORIAL_HOSTS)} or starts_with(h, 'docs.') or starts_with(h, 'doc.') or {sql_any('lower(p)', tables.TUTORIAL_PATHS)} as tutorial,
  {_BROWSER} as browser, {sql_any('u', tables.AD_URLS)} as ad, {sql_any('u', tables.AD_URLS)} or {sql_any('lower(u)', tables.MEDIA_EXTENSIONS)} as ad_or_media, true as http
from (select *, {sql_host('u')} as h, {sql_path('u')} as p, {_EXT} as e, regexp_replace({sql_host('u')}, '^[^.]+\.', '') as above from {_KINDS})"""
)
def url_kinds(spark, sf_dir):
    origin = F.regexp_extract("url", "^https?://[^/?#]+", 0)
    u = _each(table(spark, sf_dir, "pages").select("page_id", "url"), F.col("url"), *[F.concat(origin, F.lit(t)) for t in _TAILS], *map(F.lit, _SITES))
    c = F.col("u")
    own = {"language": U.code_language(c), "raw": U.is_raw_content(c), "own_key": U.domain_key(c), "parent_key": U.parent_key(U.host(c)), "tutorial": U.is_tutorial(c), "browser": U.browser_first(c), "ad": U.is_ad(c), "ad_or_media": U.is_ad(c, media=True), "http": U.is_http(c)}
    return u.select("page_id", F.col("i").cast("long").alias("i"), *[v.alias(k) for k, v in own.items()])


@query("select page_id, engine, url as target from pages, (values ('bing'), ('duckduckgo'), ('google'), ('google_full'), ('plain')) e(engine)")
def result_targets(spark, sf_dir):
    """Links as engines wrap them, unwrapped."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    packed = F.translate(F.regexp_replace(F.base64(F.col("url").cast("binary")), "[=\\r\\n]", ""), "+/", "-_")
    coded = F.url_encode("url")
    cases = {
        "bing": U.unwrapped_bing(F.concat(F.lit("https://www.bing.com/ck/a?!&u=a1"), packed, F.lit("&ntb=1"))),
        "duckduckgo": U.unwrapped_duckduckgo(F.concat(F.lit("//duckduckgo.com/l/?uddg="), coded, F.lit("&rut=1"))),
        "google": U.unwrapped_google(F.concat(F.lit("/url?q="), coded, F.lit("&sa=U"))),
        "google_full": U.unwrapped_google(F.concat(F.lit("https://www.google.com/url?sa=t&q="), coded)),
        "plain": U.unwrapped_bing(U.unwrapped_google(U.unwrapped_duckduckgo(F.col("url")))),
    }
    return p.select("page_id", F.explode(F.array(*[F.struct(F.lit(k).alias("engine"), v.alias("target")) for k, v in cases.items()])).alias("e")).select("page_id", "e.engine", "e.target")


# -- proxies

_LINES = [
    ("http://h{}.example:8080", "http", "h{}.example", 8080, 4, True, "http://h{}.example:8080"),
    ("  https://u:p@h{}.example:3128 # fast", "https", "h{}.example", 3128, 4, True, "https://u:p@h{}.example:3128"),
    ("sock5://h{}.example:1080", "socks5", "h{}.example", 1080, 3, True, "sock5://h{}.example:1080"),
    ("socks4://h{}.example:4145", "socks4", "h{}.example", 4145, 0, False, "socks4://h{}.example:4145"),
    ("h{}.example:443", "https", "h{}.example", 443, 4, True, "https://h{}.example:443"),
    ("10.0.0.1:9050", "socks5", "10.0.0.1", 9050, 3, True, "socks5://10.0.0.1:9050"),
    ("h{}.example:8000", "http", "h{}.example", 8000, 4, True, "http://h{}.example:8000"),
    ("# h{}.example:80", None, None, None, None, None, None),
    ("h{}.example", None, None, None, None, None, None),
    ("ftp://h{}.example:21", None, None, None, None, None, None),
    ("h{}.example:70000", None, None, None, None, None, None),
]


def _with_id(pattern: str, of: str = "event_id"):
    a, b = (pattern.split("{}") + [None])[:2]
    return F.lit(a) if b is None else F.concat(F.lit(a), F.col(of).cast("string"), F.lit(b))


def _sql_with_id(pattern: str | None, of: str = "event_id") -> str:
    if pattern is None:
        return "null"
    return f"replace({sql_text(pattern)}, '{{}}', cast({of} as varchar))"


def _proxy_lines(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id")
    return e.select(F.explode(F.array(*[_with_id(x[0]) for x in _LINES])).alias("value"))


_PROXIES = " union all ".join(f"select {_sql_with_id(x[6])} as url, '{x[1]}' as scheme, {_sql_with_id(x[2])} as host, {x[3]} as port, {x[4]} as priority, {x[5]} as supported from events" for x in _LINES if x[1])


@query(_PROXIES)
def proxy_lines(spark, sf_dir):
    return proxies.lines(_proxy_lines(spark, sf_dir))


@query(f"select distinct url, port from ({_PROXIES}) where scheme = 'https' order by url limit 50")
def proxy_list(spark, sf_dir):
    return proxies.listed(_proxy_lines(spark, sf_dir), "https", 50).select("url", "port")


_PORTS = [443, 8443, 1080, 9050, 80, 3128, 65535]


@query(
    "select event_id, i, 'http://user' || user_id || ':***@h.example:' || port as masked, 'u' || event_id as host, port, case when port in (443, 8443) then 'https' when port in (1080, 9050) then 'socks5' else 'http' end as scheme"
    f" from (select *, unnest({_PORTS}) as port, unnest(range({len(_PORTS)})) as i from events)"
)
def proxy_addresses(spark, sf_dir):
    e = _each(table(spark, sf_dir, "events").select("event_id", "user_id"), *map(F.lit, _PORTS), value="p")
    p = F.col("p").cast("string")
    url = F.concat(F.lit("http://user"), F.col("user_id").cast("string"), F.lit(":pw"), F.col("event_id").cast("string"), F.lit("@h.example:"), p)
    at = U.host_port(F.concat(F.lit("u"), F.col("event_id").cast("string"), F.lit(":"), p))
    return e.select("event_id", F.col("i").cast("long").alias("i"), U.masked_credentials(url).alias("masked"), at["host"].alias("host"), at["port"].alias("port"), U.scheme_by_port(at["port"]).alias("scheme"))


def _proxy_states(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id").agg((F.sum(F.floor(F.abs("value"))) % 997).cast("long").alias("latency_ms"), (F.count_if(F.col("event_type") == "error") % 4).alias("failure_count"))
    return e.select(F.concat(F.lit("http://10.0.0."), F.col("user_id").cast("string"), F.lit(":8080")).alias("url"), F.lit(4).alias("priority"), "latency_ms", "failure_count", (F.col("failure_count") < 3).alias("enabled"))


_STATES = "select 'http://10.0.0.' || user_id || ':8080' as url, cast(sum(floor(abs(value))) as bigint) % 997 as latency_ms, count_if(event_type = 'error')::bigint % 4 as failure_count from events group by user_id"


@query(f"select count(*) as total, count_if(failure_count < 3)::bigint as enabled, arg_max(url, (4000 - latency_ms - 500 * failure_count, url)) filter (failure_count < 3) as best from ({_STATES})")
def proxy_status(spark, sf_dir):
    return ST.proxy_status(_proxy_states(spark, sf_dir))


@query(f"select n.url, 'http' as scheme, 4 as priority, coalesce(latency_ms, 0) as latency_ms, coalesce(failure_count, 0) as failure_count, coalesce(failure_count < 3, true) as enabled, o.url is null as is_new from (select distinct 'http://10.0.0.' || (2 * user_id) || ':8080' as url from events) n left join ({_STATES}) o on o.url = n.url")
def proxy_reload(spark, sf_dir):
    new = table(spark, sf_dir, "events").select(F.concat(F.lit("http://10.0.0."), (2 * F.col("user_id")).cast("string"), F.lit(":8080")).alias("value"))
    return ST.reloaded(proxies.listed(new).select("url", "scheme", "priority"), _proxy_states(spark, sf_dir))


_OUTCOME = "select 'http://10.0.0.' || user_id || ':8080' as url, ts, event_id, event_type <> 'error' as ok, cast(floor(abs(value)) as bigint) as ms from events"


@query(
    f"""with o as ({_OUTCOME}), s as (select *, count_if(ok) over (partition by url order by ts, event_id rows unbounded preceding) as k from o),
f as (select url, k, count_if(not ok) as n from s group by url, k)
select o.url, list_reduce(list_prepend(0::bigint, list(ms order by ts, event_id) filter (ok)), lambda a, x: case when a = 0 then x else (a * 7 + x) // 8 end) as latency_ms,
  (select arg_max(n, k) from f where f.url = o.url)::bigint as failure_count, (select max(n) from f where f.url = o.url) < 3 as enabled from o group by o.url"""
)
def ema_latency(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    url = F.concat(F.lit("http://10.0.0."), F.col("user_id").cast("string"), F.lit(":8080"))
    rows = e.select(url.alias("url"), "ts", F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("success"), F.floor(F.abs("value")).cast("long").alias("latency_ms"))
    return ST.proxy_state(rows).select("url", "latency_ms", "failure_count", "enabled")


# -- text

_LINE = "select doc_id, unnest(string_split(text, chr(10))) as line from documents"


@query(
    rf"""select doc_id, count(*) as lines, count_if(json)::bigint as json_lines, count_if(todo)::bigint as todos, count_if(regexp_matches(line, '^\s*$'))::bigint as blank from (
  select doc_id, line, contains(lower(line), 'todo') or contains(lower(line), 'fixme') as todo,
    case when strlen(line) < 20 then false when regexp_matches(line, '^[{{\[]') and strlen(line) > 40 then true else length(regexp_replace(line, '[^{{}}\[\]":,]', '', 'g')) / strlen(line) >= 0.55 end as json
  from (select doc_id, unnest([l, '{{"key": "' || l || '"}}', '[]{{}}::,,[]""{{}}[]' || left(l, 9), l || ' FixMe']) as line from (select doc_id, unnest(string_split(text, chr(10))) as l from documents))) group by doc_id"""
)
def line_noise(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\\n")).alias("l"))
    some = F.array(F.col("l"), F.concat(F.lit('{"key": "'), "l", F.lit('"}')), F.concat(F.lit('[]{}::,,[]""{}[]'), F.substring("l", 1, 9)), F.concat("l", F.lit(" FixMe")))
    d = d.select("doc_id", F.explode(some).alias("line"))
    return d.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(T.is_json_noise(F.col("line"))).alias("json_lines"), F.count_if(T.has_todo(F.col("line"))).alias("todos"), F.count_if(F.col("line").rlike("^\\s*$")).alias("blank"))


@query(
    r"""select doc_id, md5(case when strlen(text) > 300 then left(text, 300) else text end) as cut_md5, strlen(text) > 300 as cut, strlen(text) as bytes,
  case when strlen(text) > 300 then ['content_truncated'] else ['short_content'] end as warnings,
  md5(case when strlen(text) <= 101 then text else left(text, list_max(list_filter(range(102), lambda k: strlen(left(text, k)) <= 101))) end) as prefix_md5,
  strlen(text) >= 200 and length(regexp_replace(text, '[\p{L}\p{N}=+/_-]', '', 'g')) / strlen(text) < 0.05 as blob,
  trim(regexp_replace(text, '\s+', ' ', 'g')) = text as clean from documents"""
)
def text_cuts(spark, sf_dir):
    t = F.col("text")
    cut = T.truncated(t, 300)
    warnings = T.with_warning(T.with_warning(F.array().cast("array<string>"), "content_truncated", cut["cut"]), "short_content", ~cut["cut"])
    warnings = T.with_warning(warnings, "content_truncated", cut["cut"])  # once
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(cut["text"]).alias("cut_md5"), cut["cut"].alias("cut"), F.octet_length(t).cast("long").alias("bytes"), warnings.alias("warnings"), F.md5(T.byte_prefix(t, 101)).alias("prefix_md5"), T.is_blob(t).alias("blob"), (T.clean_text(t) == t).alias("clean"))


@query(
    rf"""select doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) as clean, {sql_words('text')} as words, len(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: strlen(w) > 2)) as tokens,
  'h' || doc_id || '.example' as domain, case when doc_id % 10 >= 9 then 'Exact' when doc_id % 10 >= 7 then 'High' when doc_id % 10 >= 5 then 'Partial' else 'Low' end as band from documents"""
)
def sql_functions(spark, sf_dir):
    """The engine's functions in SQL."""
    from .plans import sql_functions as registered

    registered.register(spark)
    d = table(spark, sf_dir, "documents")
    return d.selectExpr("doc_id", "md5(web_clean_text(text)) as clean", "web_words(text) as words", "cast(size(web_tokens(text)) as bigint) as tokens", "web_domain(concat('https://H', doc_id, '.example/x')) as domain", "web_band((doc_id % 10) / 10) as band")


_MONTHS = tables.MONTHS
_DATED = ["'Jan 10, 2024 - ' || text", "'2023-11-05 | ' || text", "'September 3, 2021 · ' || text", "'2023-11-05 ' || text", "text || ' on 2022-02-03'"]
_DATE_PREFIX = rf"(?s)^(20\d{{2}}-\d{{2}}-\d{{2}}|{_MONTHS}\s+\d{{1,2}},\s+20\d{{2}})\s*[-—·|]\s+(.+)$"


@query(
    f"""select doc_id, i, case when r <> '' then regexp_extract(s, '{_DATE_PREFIX}', 1) end as date, md5(case when r <> '' then r else s end) as rest_md5,
  coalesce(nullif(regexp_extract(u, '\\b(20\\d{{2}}-\\d{{2}}-\\d{{2}})\\b', 1), ''), nullif(regexp_extract(u, '\\b({_MONTHS}\\s+\\d{{1,2}},\\s+20\\d{{2}})\\b', 1), '')) as published
  from (select *, trim(regexp_extract(s, '{_DATE_PREFIX}', 2)) as r from (select *, trim(u) as s from {_sql_each('select doc_id, text from documents', *_DATED)}))"""
)
def snippet_dates(spark, sf_dir):
    t = F.col("text")
    some = [F.concat(F.lit("Jan 10, 2024 - "), t), F.concat(F.lit("2023-11-05 | "), t), F.concat(F.lit("September 3, 2021 · "), t), F.concat(F.lit("2023-11-05 "), t), F.concat(t, F.lit(" on 2022-02-03"))]
    d = _each(table(spark, sf_dir, "documents").select("doc_id", "text"), *some)
    split = T.date_prefix(F.col("u"))
    return d.select("doc_id", F.col("i").cast("long").alias("i"), split["date"].alias("date"), F.md5(split["rest"]).alias("rest_md5"), T.published_at(F.col("u")).alias("published"))


@query(
    rf"""select doc_id, md5(case when {sql_words("last")} >= 3 then last else trim(substr(text, greatest(length(text) - 179, 1))) end) as tail_md5, len(parts) as sections, md5(parts[len(parts)]) as last_md5,
  len(kept) as paragraphs, md5(array_to_string(kept, '|')) as kept_md5
from (select doc_id, text, trim(regexp_extract(text, '(?s)^.*\. (.*)$', 1)) as last,
  list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || '## '), chr(10) || '## '), lambda x, i: case when i > 1 then '## ' || x else x end), lambda x: trim(x) <> '') as parts,
  list_filter(p, lambda x, i: coalesce(list_sum(list_transform(p[1:i - 1], lambda y: strlen(y) + 4)), 0) < 600) as kept from (select *, string_split(text, chr(10)) as p from documents))"""
)
def text_parts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumns({"parts": T.sections(F.replace("text", F.lit("\n"), F.lit("\n## "))), "kept": T.paragraphs_within(F.split("text", "\\n"), 2600)})
    return d.select("doc_id", F.md5(T.prose_tail(F.col("text"))).alias("tail_md5"), F.size("parts").cast("long").alias("sections"), F.md5(F.element_at("parts", -1)).alias("last_md5"), F.size("kept").cast("long").alias("paragraphs"), F.md5(F.array_join("kept", "|")).alias("kept_md5"))


_NAMES = ["'main-' || w", "'ad-' || w", "upper(w)", "w || '_ad'"]


@query(f"select doc_id, count_if({sql_any('lower(n)', tables.NOISE_IDENTIFIERS + tables.NOISE_EDGES)})::bigint as noise, count(*) as names from (select doc_id, unnest([{', '.join(_NAMES)}]) as n from (select doc_id, unnest(list_distinct(string_split(text, ' '))) as w from documents)) group by doc_id")
def noise_names(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("w"))
    n = w.select("doc_id", F.explode(F.array(F.concat(F.lit("main-"), "w"), F.concat(F.lit("ad-"), "w"), F.upper("w"), F.concat("w", F.lit("_ad")))).alias("n"))
    return n.groupBy("doc_id").agg(F.count_if(T.is_noise_identifier(F.col("n"))).alias("noise"), F.count("*").alias("names"))


# -- queries

_ASKED = ["rust docs", "how to use tokio", "python error message", "coffee", "react tutorial", "site:docs.rs axum crate", "bug in a go test"]
_ASK = f"(select conv_id, turn, unnest({sql_list(_ASKED)}) || ' ' || text as q, unnest(range({len(_ASKED)})) as i from conversations where role = 'user')"


def _asked(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    return _each(c, *map(F.lit, _ASKED), value="a").select("conv_id", "turn", F.col("i").cast("long").alias("i"), F.concat("a", F.lit(" "), "text").alias("q"))


_MAP = "map {" + ", ".join(f"{sql_text(k)}: {sql_list(v)}" for k, v in tables.SITES.items()) + "}"
_WITH_SITES = [w for w in tables.DEV_WORDS if w in tables.SITES]
_FLAT = f"flatten(list_transform(list_filter({sql_list(_WITH_SITES)}, lambda w: contains(lower(q), w)), lambda w: {_MAP}[w]))"
_DEV = sql_any("lower(q)", tables.DEV_WORDS + tables.DEV_PATTERNS)
_HOW = " ".join(f"when contains(lower(q), 'how to') and contains(lower(q), '{w}') then q || ' site:{tables.SITES[w][0]}'" for w in tables.HOW_TO_LANGUAGES)
_REWRITTEN = f"case when dev and not contains(lower(q), 'site:') then case when (contains(lower(q), 'docs') or contains(lower(q), 'documentation')) and len(s) > 0 then q || ' site:' || s[1] when contains(lower(q), 'error:') or contains(lower(q), 'error message') then q || ' site:stackoverflow.com' {_HOW} when contains(lower(q), 'crate') then q || ' site:docs.rs' end end"
_PLAIN = f"dev and {sql_any('lower(q)', tables.DEV_WORDS)} and not {sql_any('lower(q)', ['docs', 'documentation', 'tutorial'])}"
_SUGGESTED = f"list_filter([case when {_PLAIN} then q || ' documentation' end, case when {_PLAIN} then q || ' tutorial' end, case when len(s) > 0 then q || ' site:' || s[1] end, case when len(s) > 1 then q || ' site:' || s[2] end, case when dev and (contains(lower(q), 'error') or contains(lower(q), 'bug')) and not contains(lower(q), 'stackoverflow') then q || ' site:stackoverflow.com' end], lambda x: x is not null)"
_REWRITE = f"select *, {_REWRITTEN} as rewritten, {_SUGGESTED} as suggested from (select *, list_filter(f, lambda x, k: list_position(f, x) = k) as s from (select *, {_FLAT} as f, {_DEV} as dev from {_ASK}))"
_TRIED = "list_concat(list_filter([rewritten], lambda x: x is not null), suggested[1:3])"


@query(f"select conv_id, turn, i, md5(rewritten) as rewritten, md5(array_to_string(suggested, ' | ')) as suggestions, md5(array_to_string(list_filter(t, lambda x, k: list_position(t, x) = k and x <> q and x <> coalesce(rewritten, q)), ' | ')) as recovery from (select *, {_TRIED} as t from ({_REWRITE}))")
def query_rewrite(spark, sf_dir):
    a = T.query_forms(_asked(spark, sf_dir), "q")
    return a.select("conv_id", "turn", "i", F.md5("rewritten").alias("rewritten"), F.md5(F.array_join("suggestions", " | ")).alias("suggestions"), F.md5(F.array_join("recovery", " | ")).alias("recovery"))


@query(f"select conv_id, turn, i, {sql_any('lower(q)', tables.COMMUNITY_WORDS)} or turn < 4 as community, len(list_filter({sql_list(tables.DEV_WORDS)}, lambda w: contains(lower(q), w))) as dev_words from {_ASK}")
def query_community(spark, sf_dir):
    q = F.col("q")
    return _asked(spark, sf_dir).select("conv_id", "turn", "i", T.wants_community(q, F.col("turn")).alias("community"), F.size(T.dev_words(q)).cast("long").alias("dev_words"))


# -- quality

_HTML_WORDS = r"len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style|noscript|svg|canvas|iframe)[^>]*?>.*?</(?:script|style|noscript|svg|canvas|iframe)>', ' ', 'g'), '(?is)<(?:nav|header|footer|aside)[^>]*?>.*?</(?:nav|header|footer|aside)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '&nbsp;', ' ', 'g'), '\s+'), lambda w: w <> ''))"
_BLOCK = "case " + " ".join(f"when {sql_any('lower(h)', n)} then '{k}'" for k, n in tables.PAGE_BLOCKS.items()) + " end"
_STATUS = [200, 404, 200, 503]
_MARKS = ["", "", "<p>Please VERIFY you are human</p>", "<div class=cf-turnstile></div>"]


@query(
    f"select page_id, i, status, words, reason, reason is not null or status >= 400 as rejected, {sql_any('lower(h)', tables.CHALLENGES)} as challenge from (select *, {_BLOCK} as reason from (select page_id, unnest({_STATUS}) as status, unnest(range(4)) as i, html || unnest({sql_list(_MARKS)}) as h, {_HTML_WORDS} + unnest([0, 0, 5, 0]) as words from pages))"
)
def page_preflight(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "html")
    p = _each(p, *[F.struct(F.lit(s).alias("status"), F.concat("html", F.lit(m)).alias("h")) for s, m in zip(_STATUS, _MARKS, strict=True)])
    p = p.select("page_id", F.col("i").cast("long").alias("i"), Q.preflight(F.col("u.status"), F.col("u.h")).alias("f"), Q.has_challenge(F.col("u.h")).alias("challenge"))
    return p.select("page_id", "i", "f.status", "f.words", "f.reason", "f.rejected", "challenge")


_NOISY = "chr(10) || 'Share' || chr(10) || 'Reply' || chr(10) || 'Log in' || chr(10) || '1' || chr(10) || '2' || chr(10) || 'Follow' || chr(10) || 'Menu' || chr(10) || 'Upvote' || chr(10) || 'Like' || chr(10) || 'Tweet'"


@query(
    f"""select doc_id, i, least(greatest(1 - strlen(trim(u)) / strlen(u || '<b></b>'), 0.0), 1.0)::double as ratio, n >= 10 and (len(list_filter(l, lambda x: strlen(x) < 10 or strlen(x) < 40 and {sql_any('lower(x)', tables.CONTROL_WORDS)})) / n > 0.6 or coalesce(list_sum(list_transform(list_filter(l, lambda x: strlen(x) >= 10), lambda x: strlen(x))), 0) // n < 20) as noisy
from (select *, len(l) as n from (select *, list_transform(regexp_split_to_array(u, '\\r?\\n'), lambda x: trim(x)) as l from {_sql_each('select doc_id, text from documents', 'text', 'text || ' + _NOISY, 'left(text, 30) || ' + _NOISY)}))"""
)
def noise_share(spark, sf_dir):
    noisy = F.lit("\nShare\nReply\nLog in\n1\n2\nFollow\nMenu\nUpvote\nLike\nTweet")
    d = _each(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"), F.concat("text", noisy), F.concat(F.substring("text", 1, 30), noisy))
    u = F.col("u")
    return d.select("doc_id", F.col("i").cast("long").alias("i"), Q.noise_ratio(F.trim(u), F.concat(u, F.lit("<b></b>"))).alias("ratio"), Q.is_high_noise(u).alias("noisy"))


_ENGINES = ["duckduckgo", "ddg", "brave", "google", "bing"]
_KINDS_OF = ["media", "FONT", "script", "image"]


@query(
    f"select event_id, engine, greatest(250, case engine when 'duckduckgo' then 4500 when 'ddg' then 4500 when 'brave' then 3500 else 2500 end) as timeout_ms, kind, lower(kind) in ('media', 'font') as blocked, value >= 10 and words >= 50 and event_type = 'view' and not sparse as skips from (select event_id, event_type, value, {sql_list(_ENGINES)}[event_id % 5 + 1] as engine, {sql_list(_KINDS_OF)}[event_id % 4 + 1] as kind, event_id % 97 as words, user_id % 3 = 0 as sparse from events)"
)
def fetch_rules(spark, sf_dir):
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % len(values) + 1).cast("int"))
    e = table(spark, sf_dir, "events").withColumns({"engine": at(_ENGINES), "kind": at(_KINDS_OF), "warnings": F.when(F.col("user_id") % 3 == 0, F.array(F.lit("short_content"))).otherwise(F.array(F.lit("other")))})
    entry = F.when(F.col("event_type") == "view", "scrape").otherwise("search")
    skips = Q.skips_fetch(entry, F.when(F.col("value") >= 10, 0.6).otherwise(0.59), F.col("event_id") % 97, F.col("warnings"))
    return e.select("event_id", "engine", Q.engine_timeout_ms(F.col("engine")).alias("timeout_ms"), "kind", Q.is_media(F.col("kind")).alias("blocked"), skips.alias("skips"))


@query("select event_id, least(25 * power(2, least(greatest(n - 1, 0), 4)), 300)::bigint as seconds from (select event_id, event_id % 8 as n from events)")
def exp_backoff(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", Q.backoff_seconds(F.lit(25), F.col("event_id") % 8, F.lit(300)).alias("seconds"))


# -- fields

_SAID = "text || chr(10) || 'Unit price: $' || doc_id || '.50 each' || chr(10) || 'item count = ' || doc_id || ',000 pieces' || chr(10) || 'Lead author:  Ann O. ' || doc_id || chr(10) || 'Steps:' || chr(10) || '- open' || chr(10) || '* shut ' || doc_id || chr(10) || 'none' || chr(10) || '1. end'"
_PRICE = tables.PRICE.replace("'", "''")


def _after(keyword: str, length: int = 500) -> str:
    return f"case when strpos(lower(c), '{keyword}') > 0 then substr(c, strpos(lower(c), '{keyword}') + {len(keyword)}, {length}) end"


@query(
    rf"""select doc_id, coalesce(nullif(regexp_extract({_after('unit price')}, '{_PRICE}'), ''), nullif(regexp_extract(c, '{_PRICE}'), '')) as price, cast(replace(nullif(regexp_extract({_after('item count')}, '\d+(?:[.,]\d+)?'), ''), ',', '') as double) as number,
  case when strlen(line) > 2 then line end as author, list_filter(list_transform(list_filter(string_split({_after('steps', 2000)}, chr(10)), lambda x: regexp_matches(x, '^\s*(?:[-•*]|\d\.)\s+')), lambda x: trim(regexp_replace(x, '^\s*(?:[-•*]|\d\.)\s+', ''))), lambda x: x <> '')[1:10] as steps
from (select doc_id, c, trim(regexp_replace(regexp_extract({_after('lead author')}, '^[^\n]*'), '^[\s:]+', '')) as line from (select doc_id, {_SAID} as c from documents))"""
)
def fields_near(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    said = F.concat("text", F.lit("\nUnit price: $"), n, F.lit(".50 each\nitem count = "), n, F.lit(",000 pieces\nLead author:  Ann O. "), n, F.lit("\nSteps:\n- open\n* shut "), n, F.lit("\nnone\n1. end"))
    d, c = table(spark, sf_dir, "documents").select("doc_id", said.alias("c")), F.col("c")
    return d.select("doc_id", X.price_near(c, "unit_price").alias("price"), X.number_near(c, "item_count").alias("number"), X.text_near(c, "lead_author_name").alias("author"), X.list_near(c, "steps").alias("steps"))


_MARKDOWN = "text || ' [A](struct.A' || doc_id || '.html) [B](x/struct.B.html#m) [A](struct.A' || doc_id || '.html) [t](trait.T.html) [m](mod' || doc_id || '/index.html) the Crate `c-' || doc_id || '`'"


@query(
    r"""select doc_id, list_filter(s, lambda x, i: list_position(s, x) = i) as structs, regexp_extract_all(m, '\((?:[^()\s]*/)?trait\.([A-Za-z0-9_]+)\.html[^()]*\)', 1) as traits, regexp_extract_all(m, '\(([A-Za-z0-9_]+)/index\.html[^()]*\)', 1) as modules, nullif(regexp_extract(m, '(?i)\bcrate\s+`?([A-Za-z0-9_-]+)', 1), '') as crate"""
    rf""" from (select *, regexp_extract_all(m, '\((?:[^()\s]*/)?struct\.([A-Za-z0-9_]+)\.html[^()]*\)', 1) as s from (select doc_id, {_MARKDOWN} as m from documents))"""
)
def documented_items(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    m = F.concat("text", F.lit(" [A](struct.A"), n, F.lit(".html) [B](x/struct.B.html#m) [A](struct.A"), n, F.lit(".html) [t](trait.T.html) [m](mod"), n, F.lit("/index.html) the Crate `c-"), n, F.lit("`"))
    d, c = table(spark, sf_dir, "documents").select("doc_id", m.alias("m")), F.col("m")
    return d.select("doc_id", X.rustdoc_symbols(c, "struct").alias("structs"), X.rustdoc_symbols(c, "trait").alias("traits"), X.rustdoc_modules(c).alias("modules"), X.crate_name(F.lit("no title"), c).alias("crate"))


@query(
    """with l as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x, i: x <> '' and i % 4 <> 0) as t from documents)
select doc_id, list_filter(t, lambda x, i: list_position(t, x) = i)[1:8] as topics from l"""
)
def heading_topics(spark, sf_dir):
    """Lines as headings, every fourth of the first level."""
    level = lambda i: F.when((i + 1) % 4 == 0, "h1").when(i % 2 == 0, "h2").otherwise("h3")
    heads = F.transform(F.split("text", "\\n"), lambda x, i: F.struct(level(i).alias("level"), x.alias("text")))
    return table(spark, sf_dir, "documents").select("doc_id", X.main_topics(heads).alias("topics"))


# -- memory and caches


def _entries(spark, sf_dir) -> DataFrame:
    """Searches and pages as memory rows, written to a table and read back."""
    c = table(spark, sf_dir, "conversations")
    ts = F.timestamp_seconds(1704067200 + F.col("conv_id") * 3600 + F.col("turn"))
    key = F.concat_ws("-", "conv_id", "turn")
    said = F.regexp_replace("text", "[^A-Za-z ]", "")
    asked = M.search_entries(c.where("role = 'user'").select(F.concat(F.lit("s"), key).alias("id"), F.col("text").alias("query"), F.concat(F.lit('{"t":"'), F.repeat(said, 40), F.lit('"}')).alias("results"), F.col("turn").alias("n"), ts.alias("ts")))
    read = M.page_entries(c.where("role = 'assistant'").select(F.concat(F.lit("p"), key).alias("id"), F.concat(F.lit("https://a.example/long-path/"), key).alias("url"), F.when(F.col("turn") > 1, F.lit("A title")).alias("title"), F.col("text").alias("preview"), F.concat(F.lit("site"), (F.col("conv_id") % 9).cast("string")).alias("domain"), said.alias("result"), ts.alias("ts")))
    path = store.new_path(spark, "memory")
    M.append(asked, path)
    M.append(read, path)
    return M.read(spark, path)


_SAID_RAW = "regexp_replace(text, '[^A-Za-z ]', '', 'g')"
_RESULT = f"'{{\"t\":\"' || repeat({_SAID_RAW}, 40) || '\"}}'"
_ENTRIES = rf"""(select 's' || conv_id || '-' || turn as id, 'search' as entry_type, text as query, list_filter(regexp_split_to_array(text, '\s+'), lambda w: strlen(w) > 3)[1:5] as w, 'Search: ' || text || ' (' || turn || ' results)' as summary, null as domain, strlen({_RESULT}) > 15000 as cut, case when strlen({_RESULT}) > 15000 then 15000 end as cut_chars, null::varchar as raw from conversations where role = 'user'
union all select 'p' || conv_id || '-' || turn, 'scrape', 'https://a.example/long-path/' || conv_id || '-' || turn, ['https://a.example/long-path/' || conv_id || '-' || turn], 'Scraped: ' || case when turn > 1 then 'A title' else 'https://a.example/long-path/' || conv_id || '-' || turn end || ' - ' || text, 'site' || (conv_id % 9), strlen({_SAID_RAW}) > 15000, case when strlen({_SAID_RAW}) > 15000 then 15000 end, case when strlen({_SAID_RAW}) <= 15000 then {_SAID_RAW} end from conversations where role = 'assistant')"""


@query(f"select id, entry_type, md5(query) as query, case when len(w) = 0 then 'general_' || entry_type else lower(array_to_string(w, ' ')) end as topic, md5(summary) as summary, domain, cut, cut_chars, md5(raw) as raw from {_ENTRIES}")
def memory_entries(spark, sf_dir):
    m = _entries(spark, sf_dir)
    cut = F.get_json_object("full_result", "$._truncated") == "true"
    return m.select("id", "entry_type", F.md5("query").alias("query"), "topic", F.md5("summary").alias("summary"), "domain", F.coalesce(cut, F.lit(False)).alias("cut"), F.when(cut, F.length(F.get_json_object("full_result", "$.content"))).alias("cut_chars"), F.md5(F.get_json_object("full_result", "$._raw")).alias("raw"))


@query(f"select entry_type, count(*) as n, count(distinct domain) as domains from {_ENTRIES} where entry_type = 'scrape' group by entry_type")
def memory_of_type(spark, sf_dir):
    return _entries(spark, sf_dir).where("entry_type = 'scrape'").groupBy("entry_type").agg(F.count("*").alias("n"), F.countDistinct("domain").alias("domains"))


@query("select page_id, md5(url) as url from pages")
def cached_results(spark, sf_dir):
    """Kept for one key and read back; another key's rows and stale ones stay away."""
    p, path = table(spark, sf_dir, "pages").select("page_id", "url"), store.new_path(spark, "cache")
    now = F.lit(NOW)
    cache.write(p.withColumn("page_id", -F.col("page_id")), path, "other", now)
    cache.write(p.withColumn("page_id", F.lit(-1).cast("long")), path, "asked", now)
    cache.write(p, path, "asked", now)
    cache.write(p.where("false"), path, "asked", now)  # of an empty result nothing is kept
    fresh = cache.read(spark, path, "asked", F.lit(NOW + dt.timedelta(seconds=300)))
    stale = cache.read(spark, path, "asked", F.lit(NOW + dt.timedelta(seconds=301)))
    return fresh.unionByName(stale).select("page_id", F.md5("url").alias("url"))


@query(f"select event_id, ts > {_NOW} - interval 9 days as young from events where ts >= {_NOW} - interval 20 days")
def alive_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return ST.alive(e, "ts", F.lit(NOW), 20 * 86_400).select("event_id", (F.col("ts") > F.lit(NOW) - F.expr("interval 9 days")).alias("young"))


@query(f"select user_id, max(ts) as ts from events where ts >= {_NOW} - interval 40 days group by user_id order by ts desc, user_id limit 100")
def pruned_cache(spark, sf_dir):
    return ST.pruned(table(spark, sf_dir, "events"), "user_id", "ts", F.lit(NOW), 40 * 86_400, 100)


# -- sessions

_SESSION_KEYS = f"(select distinct case when i = 0 then replace(h, '.', '_') else replace(regexp_replace(h, '^[^.]+\\.', ''), '.', '_') end as key, i from (select {sql_host('url')} as h, case when contains(url, '/en/') then 0 else 1 end as i from pages))"


@query(f"select page_id, coalesce(o.i, a.i)::integer as cookies from (select page_id, url, replace({sql_host('url')}, '.', '_') as own, replace(regexp_replace({sql_host('url')}, '^[^.]+\\.', ''), '.', '_') as above from pages) p left join (select key, min(i) as i from {_SESSION_KEYS} group by key) o on o.key = p.own left join (select key, min(i) as i from {_SESSION_KEYS} group by key) a on a.key = p.above")
def session_lookup(spark, sf_dir):
    """Sessions of the hosts of English pages and of the domains above the others' hosts."""
    p = table(spark, sf_dir, "pages")
    english = F.contains("url", F.lit("/en/"))
    keys = p.select(F.when(english, U.domain_key(F.col("url"))).otherwise(U.parent_key(U.host(F.col("url")))).alias("key"), F.when(english, 0).otherwise(1).alias("cookies"))
    found = ST.session_of(p.select("url").distinct(), keys.groupBy("key").agg(F.min("cookies").alias("cookies")))
    return p.select("page_id", "url").join(found, "url").select("page_id", "cookies")


@query(
    "select event_id, case when n = 0 then null else coalesce(nullif(least(case when user_id > 0 then 1000.0 + user_id else 1e300 end, case when n > 1 and value > 0 then 1000.0 + value else 1e300 end), 1e300), 1000.0 + 86400) end as expiry, "
    "coalesce(1000.0 < case when n = 0 then null else coalesce(nullif(least(case when user_id > 0 then 1000.0 + user_id else 1e300 end, case when n > 1 and value > 0 then 1000.0 + value else 1e300 end), 1e300), 1000.0 + 86400) end - 60, true) as valid from (select *, event_id % 3 as n from events)"
)
def session_times(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    one = F.struct(F.when(F.col("user_id") > 0, 1000.0 + F.col("user_id")).otherwise(-1.0).alias("expires"))
    two = F.struct(F.when(F.col("value") > 0, 1000.0 + F.col("value")).otherwise(0.0).alias("expires"))
    cookies = F.slice(F.array(one, two), F.lit(1), (F.col("event_id") % 3).cast("int"))
    expiry = ST.session_expiry(cookies, F.lit(1000))
    return e.select("event_id", expiry.alias("expiry"), ST.session_valid(expiry, F.lit(1000.0)).alias("valid"))


# -- engines

_RUN_ENGINES = "select user_id % 40 as idx, 'e' || (user_id % 40) as engine, max(ts) filter (event_type <> 'purchase') as cooldown_until from events group by user_id % 40"


def _engines(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 40).alias("idx")).agg(F.max(F.when(F.col("event_type") != "purchase", F.col("ts"))).alias("cooldown_until"))
    return e.select("idx", F.concat(F.lit("e"), F.col("idx").cast("string")).alias("engine"), "cooldown_until")


_AS_OF = [dt.datetime(2024, 1, 31, 20), dt.datetime(2030, 1, 1), dt.datetime(2020, 1, 1)]


@query(
    " union all ".join(
        f"select {k} as no, place, engine from (select engine, ready, any_, row_number() over (order by case when any_ then turn end, cooldown_until nulls first, turn) as place from (select *, (idx - 7 + n) % n as turn, bool_or(ready) over () as any_ from (select *, count(*) over () as n, coalesce(cooldown_until <= timestamp '{t}', true) as ready from ({_RUN_ENGINES}))) where ready or not any_) where place <= case when any_ then 3 else 1 end"
        for k, t in enumerate(_AS_OF)
    )
)
def engine_choice(spark, sf_dir):
    e, out = _engines(spark, sf_dir), None
    for k, t in enumerate(_AS_OF):
        one = ST.chosen_engines(e, 7, F.lit(t)).select(F.lit(k).alias("no"), F.col("place").cast("long").alias("place"), "engine")
        out = one if out is None else out.unionByName(one)
    return out


@query(" union all ".join(f"(select {k} as no, engine from (select *, coalesce(cooldown_until <= timestamp '{t}', true) as ready from ({_RUN_ENGINES}) where idx % 2 = 1) order by ready desc, case when not ready then cooldown_until end nulls first, idx limit 1)" for k, t in enumerate(_AS_OF)))
def engine_rescue(spark, sf_dir):
    e, out = _engines(spark, sf_dir), None
    for k, t in enumerate(_AS_OF):
        one = ST.rescue_engine(e, e.where("idx % 2 = 0"), F.lit(t)).select(F.lit(k).alias("no"), "engine")
        out = one if out is None else out.unionByName(one)
    return out


_LABELLED = "select user_id % 40 as e, case event_type when 'error' then 'blocked' when 'click' then 'timeout' when 'signup' then 'skipped' when 'view' then 'recovered' else 'success' end as status, event_type as reason from events"


@query(f"select kind, label from (select case when status in ('blocked', 'timeout') then 'unresponsive' when status = 'recovered' then 'degraded' when status = 'skipped' then 'skipped' end as kind, 'e' || e || ':' || reason as label from ({_LABELLED})) where kind is not null group by kind, label")
def engine_labels(spark, sf_dir):
    status = F.when(F.col("event_type") == "error", "blocked").when(F.col("event_type") == "click", "timeout").when(F.col("event_type") == "signup", "skipped").when(F.col("event_type") == "view", "recovered").otherwise("success")
    runs = table(spark, sf_dir, "events").select(F.concat(F.lit("e"), (F.col("user_id") % 40).cast("string")).alias("engine"), status.alias("status"), F.col("event_type").alias("reason"))
    lists = S.run_labels(runs)
    return lists.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, lists.columns)), F.array(*lists.columns))).alias("kind", "labels")).select("kind", F.explode("labels").alias("label"))


# -- sets of URLs

_LINKS = "(select distinct regexp_extract(html, '<html[^>]*lang=\"([^\"]*)\"', 1) as lang, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) as href from pages)"


def _links(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("html", '<html[^>]*lang="([^"]*)"', 1).alias("lang"), F.explode(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))).alias("href"))


@query(f"select href from {_LINKS} where lang = 'en' intersect select href from {_LINKS} where lang <> 'en'")
def links_in_common(spark, sf_dir):
    h = _links(spark, sf_dir)
    return h.where("lang = 'en'").select("href").intersect(h.where("lang <> 'en'").select("href"))


@query(f"select href from {_LINKS} where lang = 'en' except select href from {_LINKS} where lang <> 'en'")
def links_only_in(spark, sf_dir):
    h = _links(spark, sf_dir)
    return h.where("lang = 'en'").select("href").subtract(h.where("lang <> 'en'").select("href"))


_HREF = "(select page_id, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) as href from pages)"


@query(f"select href as url, 'page ' || min(page_id) as via from {_HREF} group by href")
def first_queries(spark, sf_dir):
    h = _links(spark, sf_dir).select(F.col("href").alias("url"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("query"), F.col("page_id").alias("ord"))
    return M.first_via(h)


@query(f"select href as url, min(page_id) as ord from {_HREF} where href not in (select href from {_LINKS} where lang = 'en') group by href order by ord, url limit 60")
def unseen_links(spark, sf_dir):
    h = _links(spark, sf_dir)
    return D.unseen(h.select(F.col("href").alias("url"), F.col("page_id").alias("ord")), h.where("lang = 'en'").select(F.col("href").alias("url")), 60)


@query("select page_id, i, case i when 0 then [url, url || '/a'] when 1 then [url, url || '/b', url || '/c'] when 2 then [url || '/d'] else [] end as urls from pages, range(4) t(i)")
def logged_urls(spark, sf_dir):
    u = F.col("url")
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    some = [
        text('[{"url":"', u, '"},{"url":"', u, '/a"},{"url":"', u, '"},{"url":"ftp://x"}]'),
        text('{"all_urls":["', u, '","', u, '/b",""],"top_sources":["', u, '"],"key_findings":[{"url":"', u, '/c"}]}'),
        text('["', u, '/d"]'),
        text("{not json ", u),
    ]
    p = _each(table(spark, sf_dir, "pages").select("page_id", "url"), *some, value="json")
    rows = D.logged_urls(p.select(F.struct("page_id", "i").alias("id"), "json"))
    return rows.select("id.page_id", F.col("id.i").cast("long").alias("i"), "urls")


# -- pages with what the table's pages lack

_HEAD = '<meta name="description" content="About {}"><meta name="keywords" content="k{}, all"><meta property="og:title" content="OG {}"><meta property="og:description" content="OD {}"><meta property="og:image" content="/og/{}.png"><meta property="og:site_name" content="Site {}"><meta name="author" content="Ann {}"><meta property="article:published_time" content="2024-01-0{}"><link rel="canonical" href="/c/{}"><script type="application/ld+json">{{"@type":"Article","headline":"H{}"}}</script><script id="__NEXT_DATA__" type="application/json">{{"n":{}}}</script>'
_BODY = '<img src="/i/{}.png" alt="a{}" title="t"><img src="data:x"><pre><code class="language-python">value = compute({})</code></pre><h2>Part {}</h2><h3> Sub  {} </h3></article>'


def _filled(pattern: str):
    return F.concat(*[x for piece in pattern.replace("{{", "\x01").replace("}}", "\x02").split("{}") for x in (F.lit(piece.replace("\x01", "{").replace("\x02", "}")), F.col("page_id").cast("string"))][:-1])


def _rich_pages(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    html = F.replace(F.replace("html", F.lit('<meta charset="utf-8">'), _filled(_HEAD)), F.lit("</article>"), _filled(_BODY))
    return p.select("page_id", "url", html.alias("html"))


_ORIGIN = "regexp_extract(url, '^https?://[^/?#]+')"


@query(
    f"select page_id, 'About ' || page_id as description, 'k' || page_id || ', all' as keywords, 'OG ' || page_id as og_title, 'OD ' || page_id as og_description, {_ORIGIN} || '/og/' || page_id || '.png' as og_image, 'Site ' || page_id as site_name, 'Ann ' || page_id as author, '2024-01-0' || page_id as published_at, {_ORIGIN} || '/c/' || page_id as canonical from pages"
)
def page_meta(spark, sf_dir):
    p = P.parsed(_rich_pages(spark, sf_dir), ["meta_description", "meta_keywords", "og_title", "og_description", "og_image", "site_name", "author", "published_at", "canonical_url"])
    return p.select("page_id", F.col("meta_description").alias("description"), F.col("meta_keywords").alias("keywords"), "og_title", "og_description", "og_image", "site_name", "author", "published_at", F.col("canonical_url").alias("canonical"))


@query(
    f"select page_id, {_ORIGIN} || '/i/' || page_id || '.png' as src, 'a' || page_id as alt, 'python' as language, 'value = compute(' || page_id || ')' as code, 'Part ' || page_id as h2, 'Sub ' || page_id as h3 from pages where contains(html, '</article>')"
)
def page_parts(spark, sf_dir):
    p = P.parsed(_rich_pages(spark, sf_dir), ["images", "code_blocks", "headings"]).where(F.size("code_blocks") > 0)
    level = lambda n: F.filter("headings", lambda h: h["level"] == n)
    last = lambda a: F.element_at(a, -1)
    img = F.filter("images", lambda i: F.contains(i["src"], F.lit("/i/")))[0]
    return p.select("page_id", img["src"].alias("src"), img["alt"].alias("alt"), last(F.col("code_blocks"))["language"].alias("language"), F.trim(last(F.col("code_blocks"))["code"]).alias("code"), last(level("h2"))["text"].alias("h2"), last(level("h3"))["text"].alias("h3"))


_LINKED = '<html><head><title>T</title><script type="application/ld+json">{{"@type":"Product","name":"N{}","description":"D","offers":{{"@type":"Offer","price":{} }},"brand":{{"name":"B{}"}} }}</script><script type="application/ld+json">[{{"@type":"NewsArticle","headline":"H{}","author":[{{"name":"A"}},{{"name":"C{}"}}],"datePublished":"2024-01-01"}},{{"@graph":[{{"@type":"RealEstateListing","name":"L{}","address":{{"streetAddress":"S {}","addressLocality":"X"}},"offers":[{{"lowPrice":{} }}]}}]}},{{"@type":"Person","name":"P{}"}}]</script></head><body><p>few words</p></body></html>'
_STATE = '<html><head><title>T</title><script id="__NEXT_DATA__" type="application/json">{{"props":{{"title":"T {}","items":["a","b{}"],"count":{},"id":"x","deep":[{{"k":"v{}"}}]}},"pad":"' + " ".join(f"w{i}" for i in range(60)) + '"}}</script></head><body><p>few words</p></body></html>'
_REPEATED = "<html><body><article><p>intro{} " + "p q r s " * 9 + "x y z " * 9 + "tail{}</p></article></body></html>"


def _made_pages(spark, sf_dir, html: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", F.concat(_filled(html + "{}"), F.lit("")).alias("html"))


@query(
    "select page_id, 'Product: N' || page_id || ' Description: D Price: ' || page_id || ' Brand: B' || page_id || ' --- Title: H' || page_id || ' Author: A, C' || page_id || ' Published: 2024-01-01 --- Listing: L' || page_id || ' Address: S ' || page_id || ', X Price: ' || page_id || ' --- Person: P' || page_id as text, 2::bigint as sources from pages"
)
def page_linked_data(spark, sf_dir):
    """Pages that say little besides their linked data."""
    p = P.parsed(_made_pages(spark, sf_dir, _LINKED), ["clean_content", "embedded_sources"])
    return p.select("page_id", F.col("clean_content").alias("text"), F.size("embedded_sources").cast("long").alias("sources"))


@query(f"select page_id, 'pad: {' '.join(f'w{i}' for i in range(60))} props.count: ' || page_id || ' props.deep.0.k: v' || page_id || ' props.items: a, b' || page_id || ' props.title: T ' || page_id as text, page_id as n from pages")
def page_state(spark, sf_dir):
    """Pages that keep their content in the state of an application."""
    p = P.parsed(_made_pages(spark, sf_dir, _STATE), ["clean_content", "embedded_state_json"])
    return p.select("page_id", F.col("clean_content").alias("text"), F.get_json_object("embedded_state_json", "$.props.count").cast("long").alias("n"))


@query("select page_id, 'intro' || page_id || ' p q r s x y z tail' || page_id as text from pages")
def page_repeats(spark, sf_dir):
    """Word runs that repeat, once."""
    return P.parsed(_made_pages(spark, sf_dir, _REPEATED), ["clean_content"]).select("page_id", F.col("clean_content").alias("text"))


_PARAGRAPHS = "list_filter(string_split(c, chr(10) || chr(10)), lambda p: " + sql_words("p") + " >= case when w < 200 then 3 else 8 end and not " + sql_any("lower(p)", tables.BOILERPLATE) + ")"


@query(
    rf"""select doc_id, md5(array_to_string(list_filter(ps, lambda x, i: coalesce(list_sum(list_transform(ps[1:i - 1], lambda y: strlen(y) + 4)), 0) < 8000), '|')) as paragraphs,
  md5(array_to_string(list_filter(list_transform(ps, lambda p: regexp_extract(p, '^(.+?[.!?])(?:\s|$)', 1)), lambda x: {sql_words('x')} >= 4), '|')) as key_points
from (select *, {_PARAGRAPHS} as ps from (select doc_id, replace(text, chr(10), chr(10) || chr(10)) as c, {sql_words('text')} as w from documents))"""
)
def clean_json(spark, sf_dir):
    """Documents as fetched pages, their lines as paragraphs."""
    from .plans import api

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("url"), F.lit("t").alias("title"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("clean_content"), T.word_count(F.col("text")).alias("word_count"))
    return api.clean_json(d).select(F.col("url").cast("long").alias("doc_id"), F.md5(F.array_join("paragraphs", "|")).alias("paragraphs"), F.md5(F.array_join("key_points", "|")).alias("key_points"))


@query("select md5(string_agg(url, ',' order by page_id)) as related, md5(string_agg(case when page_id % 3 = 0 then 's' || page_id || ',t' end, ',' order by page_id)) as suggestions, 0::bigint as warnings, arg_min('r' || page_id, page_id) filter (page_id % 5 = 2) as rewrite, arg_min('a' || page_id, page_id) filter (page_id % 7 = 4) as answer from pages")
def engine_extras(spark, sf_dir):
    n = F.col("page_id").cast("string")
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), F.array("url").alias("related"), F.when(F.col("page_id") % 3 == 0, F.array(F.concat(F.lit("s"), n), F.lit("t"))).alias("suggestions"), F.array().cast("array<string>").alias("warnings"), F.when(F.col("page_id") % 5 == 2, F.concat(F.lit("r"), n)).alias("rewrite"), F.when(F.col("page_id") % 7 == 4, F.concat(F.lit("a"), n)).alias("answer"))
    x = S.merged_extras(p)
    return x.select(F.md5(F.array_join("related", ",")).alias("related"), F.md5(F.array_join("suggestions", ",")).alias("suggestions"), F.size("warnings").cast("long").alias("warnings"), "rewrite", "answer")


_ARTICLE = (
    '<html><head><meta property="og:description" content="OD {}"></head><body><article><h2>A {}</h2><p>See <a href="/x">link</a> and <b>bold</b> &amp; more.</p><ul><li>one</li><li>two {}</li></ul><pre><code class="language-python">import os\nimport sys\nimport re\nimport json\nimport math\n'
    + "\n".join(f"a{i} = {i}" for i in range(12))
    + "\n# TODO {}</code></pre></article></body></html>"
)
_CODE = "'" + "".join(f"a{i} = {i}\n" for i in range(12)) + "# TODO ' || page_id"


@query(
    f"""select page_id, md5('## A ' || page_id || '\n\nSee [link](/x) and **bold** & more.\n\n- one\n\n- two ' || page_id || '\n\n```python\nimport os\nimport sys\nimport re\nimport json\nimport math\n' || {_CODE} || '\n```') as markdown, {_CODE} as code, 'OD ' || page_id as short from pages"""
)
def page_markdown(spark, sf_dir):
    """Markdown of made pages, code without its block of imports, and what stands for pages that say nothing themselves."""
    p = P.parsed(_made_pages(spark, sf_dir, _ARTICLE), ["markdown", "code_blocks"]).select("page_id", F.md5("markdown").alias("markdown"), F.col("code_blocks")[0]["code"].alias("code"))
    bare = '<html><head><meta property="og:description" content="OD {}"></head><body><p>few words</p></body></html>'
    short = P.parsed(_made_pages(spark, sf_dir, bare), ["clean_content"]).select("page_id", F.col("clean_content").alias("short"))
    return p.join(short, "page_id")


_RAW = '<div class="c" role="x" id="i"><details open><summary> More {} </summary><p style="a">b {}</p></details><nav>n</nav><form>f</form><p data-k="1" tabindex="2" onclick="f()">c</p></div><div class="cookie-bar">accept</div><p aria-hidden="true">gone</p>'


@query("select page_id, '<div role=\"x\"><section><h3>More ' || page_id || '</h3><p>b ' || page_id || '</p></section> <p data-k=\"1\" tabindex=\"2\">c</p></div> ' || page_id as balanced, '<div><section><h3>More ' || page_id || '</h3><p>b ' || page_id || '</p></section> <p>c</p></div> ' || page_id as aggressive from pages")
def html_preprocess(spark, sf_dir):
    p = _made_pages(spark, sf_dir, _RAW)
    return p.select("page_id", T.preprocess_html(F.col("html")).alias("balanced"), T.preprocess_html(F.col("html"), aggressive=True).alias("aggressive"))


def _encoded(url):
    return F.url_encode(url)


@query(
    """select page_id, engine, rank::integer as rank, case when rank = 0 then url else 'https://other.example/' || page_id end as url, 'T' || rank || ' ' || page_id as title, 'About ' || page_id as content, case when rank = 0 then '2024-01-10' end as published_at
from pages, (values ('bing'), ('brave'), ('duckduckgo'), ('google')) e(engine), (values (0), (1)) r(rank)"""
)
def serp_results(spark, sf_dir):
    """Result pages of four engines made of the pages' addresses: two results, one of the engine's own or no page, and one more than is asked for."""
    from .sources import serp

    p = table(spark, sf_dir, "pages").select("page_id", "url")
    n = F.col("page_id").cast("string")
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    other = text("https://other.example/", n)
    packed = lambda u: F.translate(F.regexp_replace(F.base64(u.cast("binary")), "[=\\r\\n]", ""), "+/", "-_")
    said = lambda k: text("2024-01-10 - About " if k == 0 else "About ", n)

    def page(open_, row, close, skipped):
        return text(open_, row(F.col("url"), 0), row(other, 1), skipped, row(other, 2), close)

    google = page('<div id="search">', lambda u, k: text('<div class="MjjYud"><a href="/url?q=', _encoded(u), f'&amp;sa=U"><h3>T{k} ', n, '</h3></a><div class="VwiC3b">', said(k), "</div></div>"), "</div>", '<div class="MjjYud"><a href="/url?q=https%3A%2F%2Fmaps.google.com%2Fx"><h3>own</h3></a></div>')
    bing = page("<ol>", lambda u, k: text('<li class="b_algo"><h2><a href="https://www.bing.com/ck/a?!&amp;u=a1', packed(u), f'&amp;ntb=1">T{k} ', n, '</a></h2><div class="b_caption"><p>', said(k), "</p></div></li>"), "</ol>", '<li class="b_algo"><p>no link</p></li>')
    duck = page("<div>", lambda u, k: text('<div class="results_links"><a class="result__a" href="//duckduckgo.com/l/?uddg=', _encoded(u), f'&amp;rut=1">T{k} ', n, '</a><a class="result__snippet">', said(k), "</a></div>"), "</div>", '<div class="results_links"><a href="/none">none</a></div>')
    brave = page("<main>", lambda u, k: text('<div><a href="', F.replace(u, F.lit("&"), F.lit("&amp;")), f'"><h3>T{k} ', n, '</h3></a><div class="snippet-description">', said(k), "</div></div>"), "</main>", '<div><a href="/settings">none</a></div>')
    made = p.select(F.col("page_id").alias("serp_id"), F.explode(F.map_from_arrays(F.array(*map(F.lit, ("google", "bing", "duckduckgo", "brave"))), F.array(google, bing, duck, brave))).alias("engine", "html"))
    r = serp.parsed(made, per_engine=2)
    return r.select(F.col("serp_id").alias("page_id"), "engine", "rank", "url", "title", "content", "published_at")


_MAIL = tables.EMAIL.replace("'", "''")


@query(
    rf"""select doc_id, to_json(map_from_entries([('page_title', [t]), ('page_type', ['documentation']), ('summary', [d]), ('emails', regexp_extract_all(c, '{_MAIL}')), ('price', case when p <> '' then [p] else [] end)])) as data,
  round(least(0.4 * (3 + e + case when p <> '' then 1 else 0 end) / 5.0 + 0.4 * (3 + e + case when p <> '' then 1 else 0 end) / (2.0 + e + case when p <> '' then 1 else 0 end) + 0.2 * case when p = '' then 1.0 when try_cast(p as double) is not null then 1.0 else 0.0 end, 1.0), 6)::double as confidence
from (select *, case when len(regexp_extract_all(c, '{_MAIL}')) > 0 then 1 else 0 end as e, coalesce(nullif(regexp_extract(case when strpos(lower(c), 'price') > 0 then substr(c, strpos(lower(c), 'price') + 5, 500) else '' end, '{_PRICE}'), ''), regexp_extract(c, '{_PRICE}')) as p
  from (select doc_id, text as c, 'Guide ' || doc_id as t, 'All of ' || doc_id as d from documents))"""
)
def field_confidence(spark, sf_dir):
    """Fields of documents as pages, and how far they can be trusted."""
    from .operators import extract as E

    n = F.col("doc_id").cast("string")
    none = F.lit(None).cast("string")
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("page_id"), F.concat(F.lit("https://a.example/docs/"), n).alias("url"), F.concat(F.lit("Guide "), n).alias("title"), F.concat(F.lit("All of "), n).alias("meta_description"), F.col("text").alias("clean_content"),
        F.array().cast("array<struct<level:string,text:string>>").alias("headings"), F.lit("documentation").alias("page_type"), none.alias("author"), none.alias("published_at"), T.word_count(F.col("text")).alias("word_count"), F.array().cast("array<string>").alias("warnings"),
    )
    schema = [X.Field("page_title"), X.Field("page_type"), X.Field("summary"), X.Field("emails"), X.Field("price", kind="number")]
    return E.extracted(d, schema).select(F.col("page_id").alias("doc_id"), F.to_json("data").alias("data"), "confidence")


@query(
    "select lang, count_if(ts > timestamp '2024-01-02 00:00:00' - interval 5 minutes) >= 2 as rapid from (select *, row_number() over (partition by lang order by sim desc, conv_id) as nth from (select conv_id, lang, timestamp '2024-01-01 23:56:00' + conv_id * interval 1 second as ts, round(greatest(list_dot_product(v, q) / nullif(sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q)), 0), 0.0), 6) as sim"
    " from (select vec_id as conv_id, label as lang, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings), (select list_transform(embedding, lambda x: cast(x as double)) as q from embeddings where vec_id = 3))) where nth <= 3 and sim >= 0.95 group by lang"
)
def rapid_testing(spark, sf_dir):
    """Whether like pages were fetched shortly before, for the vectors of each label."""
    e = table(spark, sf_dir, "embeddings")
    probe = F.array(*[F.lit(x) for x in e.where("vec_id = 3").first()["embedding"]])
    rows = e.select(F.col("vec_id").alias("id"), F.lit("scrape").alias("entry_type"), (F.lit(dt.datetime(2024, 1, 1, 23, 56)) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("vec_id"))).alias("ts"), F.col("embedding").alias("vector"), "label")
    return M.rapid_testing_of(rows, probe, F.lit(dt.datetime(2024, 1, 2)), "label").select(F.col("label").alias("lang"), "rapid")


@query(f"select doc_id, asked, case when w < 200 then 'semantic_shave: bypassed (word_count < 200)' when asked then 'semantic_shave: kept' else 'semantic_shave_missing_query' end as warning, w <= 200 or not asked as whole from (select doc_id, {sql_words('text')} as w from documents), (values (true), (false)) a(asked)")
def shave_gate(spark, sf_dir):
    """What becomes of documents as fetched pages, with a query that nothing is like and without one."""
    from .operators import relevance as R

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("url"), F.col("text").alias("clean_content"), T.word_count(F.col("text")).alias("word_count"), F.array().cast("array<string>").alias("warnings"))
    out = None
    for asked, q in ((True, "zzzq qqqz"), (False, " ")):
        g = R.gated(d.withColumn("before", F.md5("clean_content")), q)
        one = g.select(F.col("url").cast("long").alias("doc_id"), F.lit(asked).alias("asked"), F.regexp_replace(F.col("warnings")[0], "kept .*$", "kept").alias("warning"), ((F.md5("clean_content") == F.col("before")) | (F.lit(asked) & (F.col("word_count") < 200) & F.startswith(F.col("warnings")[0], F.lit("semantic_shave: bypassed")))).alias("whole"))
        out = one if out is None else out.unionByName(one)
    return out


# -- streams


def _streamed(spark, sf_dir, parts: list[DataFrame], name: str) -> DataFrame:
    """Daily windows of the parts, each read by a run of its own of one stream, as far as the stream has closed them."""
    path = store.new_path(spark, name)
    for k, part in enumerate(parts):
        part.write.parquet(f"{path}/in/batch={k}")
        rows = spark.readStream.schema(parts[0].schema).parquet(f"{path}/in/batch=*")
        q = EV.tumbling(rows).writeStream.outputMode("append").option("checkpointLocation", f"{path}/state").format("parquet").option("path", f"{path}/out").trigger(availableNow=True).start()
        q.awaitTermination()
    closed = spark.read.schema("start timestamp, event_type string, n long, total double").parquet(f"{path}/out")
    return closed.withColumn("start", F.col("start").cast("timestamp_ntz"))


_CLOSED = "select time_bucket(interval 1 day, ts) as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by start, event_type having time_bucket(interval 1 day, ts) + interval 1 day <= (select max(ts) from events) - interval 1 hour"


@query(_CLOSED)
def streamed_windows(spark, sf_dir):
    return _streamed(spark, sf_dir, [table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")], "stream")


@query("with b as (select *, time_bucket(interval 1 day, ts) as day from events), m as (select max(day) as last from b) select day as start, event_type, count(*) as n, round(sum(value), 6) as total from b, m where day >= last - interval 3 days and day < last group by day, event_type")
def late_events(spark, sf_dir):
    """The last days come first; what is older than the watermark of two parts before is late, and dropped."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    last = e.agg(F.date_trunc("day", F.max("ts"))).first()[0]
    first = F.col("ts") >= F.lit(last) - F.expr("interval 3 days")
    return _streamed(spark, sf_dir, [e.where(first & (F.col("ts") < F.lit(last))), e.where(F.col("ts") >= F.lit(last)), e.where(~first)], "late")
