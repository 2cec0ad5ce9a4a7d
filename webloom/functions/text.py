"""Text, query text, dates: Column to Column, without Python on the executors but for query_hits.

Null in, null out, unless a function says otherwise.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import tables
from . import needles as N

SPACE = "(?U)\\s+"


#: Needles that are looked for one after the other; more are one pattern, as code for them would grow too large to be compiled.
FEW = 24


def has_any(text: Column, needles: list[str]) -> Column:
    """Whether any of the needles is in text, as it is written."""
    if len(needles) <= FEW:
        return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles])
    return text.rlike("|".join(re.sub(r"([\\.^$|?*+(){}\[\]])", r"\\\1", n) for n in needles))


def first_match(cases: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first condition that holds."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    (condition, value), *rest = cases
    return reduce(lambda w, c: w.when(c[0], lit(c[1])), rest, F.when(condition, lit(value))).otherwise(lit(otherwise))


def or_null(text: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(text, F.lit(""))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match of a pattern, or null."""
    return or_null(F.regexp_extract(text, pattern, group))


def clean_text(text: Column) -> Column:
    """White space, line ends too, becomes one space; trimmed."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("(?U)\\S+")), F.lit(0)).cast("long")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits longer than two bytes."""
    return F.filter(F.split(F.lower(text), "[^\\p{IsAlphabetic}\\p{N}]+"), lambda w: F.octet_length(w) > 2)


def relevance(query: list[str], title: Column, content: Column) -> Column:
    """Share of the query's tokens found, those in the title weighing double; 0.5 for a query without tokens."""
    if not query:
        return F.lit(0.5)
    # a text is split once, and only the query's tokens are kept of it; a token that the query repeats counts again
    n, times = len(query), {k: [t for t in dict.fromkeys(query) if query.count(t) > k] for k in range(len(query))}
    parts = lambda text: F.split(F.lower(text), "[^\\p{IsAlphabetic}\\p{N}]+")
    in_title, in_content = (F.array_intersect(F.array(*[F.lit(t) for t in times[0]]), parts(x)) for x in (title, content))
    some = [(in_title, in_content)] + [(F.array_intersect(in_title, more), F.array_intersect(in_content, more)) for k in range(1, n) if times[k] for more in [F.array(*[F.lit(t) for t in times[k]])]]
    titles = sum((F.size(t) for t, _ in some), F.lit(0))
    all_ = sum((F.size(F.array_union(t, c)) for t, c in some), F.lit(0))
    return F.round(F.least(F.lit(1.0), (F.least((titles * 0.4 + (all_ - titles) * 0.2) / (0.4 * n), F.lit(1.0)) + all_ / n) / 2), 6)


def query_tokens(query: str) -> list[str]:
    return [t for t in re.split(r"[^\w]|_", query.lower()) if len(t.encode()) > 2]


def signature(title: Column, content: Column, chars: int = 140) -> Column:
    """What makes two results the same: title and the beginning of the content, without case and spacing."""
    return F.concat(F.trim(F.lower(title)), F.lit("|"), clean_text(F.lower(F.substring(content, 1, chars))))


def is_json_noise(line: Column) -> Column:
    """Whether a line is leaked JSON: it begins like it or consists of its marks."""
    n = F.octet_length(line)
    marks = F.length(F.regexp_replace(line, "[^{}\\[\\]\":,]", ""))
    return F.when(n < 20, False).when(line.rlike("^[{\\[]") & (n > 40), True).otherwise(marks / n >= 0.55)


def is_blob(text: Column) -> Column:
    """Whether a long string is encoded data: hardly anything but letters, digits and = + / - _."""
    other = F.length(F.regexp_replace(text, "[\\p{IsAlphabetic}\\p{N}=+/_-]", ""))
    return (F.octet_length(text) >= 200) & (other / F.octet_length(text) < 0.05)


def is_noise_identifier(name: Column) -> Column:
    return has_any(F.lower(name), tables.NOISE_IDENTIFIERS + tables.NOISE_EDGES)


def has_todo(code: Column) -> Column:
    return code.rlike("(?i)todo|fixme")


def truncated(text: Column, limit: int) -> Column:
    """struct(text, cut): the first `limit` characters where the bytes are more than that."""
    over = F.octet_length(text) > limit
    return F.struct(F.when(over, F.substring(text, 1, limit)).otherwise(text).alias("text"), over.alias("cut"))


def with_warning(warnings: Column, warning: str, condition: Column) -> Column:
    return F.when(condition, F.array_union(warnings, F.array(F.lit(warning)))).otherwise(warnings)


def prose_tail(text: Column) -> Column:
    """The last sentence if it has three words, else the last 180 characters."""
    last = F.trim(F.regexp_extract(text, "(?s)^.*\\. (.*)$", 1))
    return F.when(word_count(last) >= 3, last).otherwise(F.trim(F.substr(text, F.greatest(F.length(text) - 179, F.lit(1)))))


def preprocess_html(html: Column, aggressive: bool = False) -> Column:
    """HTML without scripts, navigation, forms, hidden parts, advertising and attributes that say nothing."""
    h = F.regexp_replace(html, "(?is)<summary[^>]*>\\s*</summary>", "<h3>Summary</h3>")
    h = F.regexp_replace(h, "(?is)<summary[^>]*>\\s*(.*?)\\s*</summary>", "<h3>$1</h3>")
    h = F.regexp_replace(F.regexp_replace(h, "(?is)<details[^>]*>", "<section>"), "(?is)</details>", "</section>")
    for pattern in tables.BLOCK_PATTERNS:
        h = F.regexp_replace(h, pattern, " ")
    return F.regexp_replace(F.regexp_replace(h, tables.ATTRIBUTES_AGGRESSIVE if aggressive else tables.ATTRIBUTES, ""), "\\s{2,}", " ")


def html_text(html: Column) -> Column:
    """Text of simple HTML: blocks and tags go, the usual entities are read."""
    t = F.regexp_replace(F.regexp_replace(preprocess_html(html), "(?s)<!--.*?-->", " "), "(?s)<[^>]+>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return clean_text(t)


def sections(markdown: Column) -> Column:
    """Parts of a markdown text, each beginning at a heading."""
    return F.filter(F.split(markdown, "(?m)\\n(?=#{1,6}(?!#))"), lambda s: F.trim(s) != "")


def chunks(text: Column, window: int = 200, stride: int = 100, w: Column | None = None) -> Column:
    """Overlapping runs of words; the last ends with the text; a short text is one chunk, as it is.

    w: a column of words(text); without it they are split anew for each chunk.
    """
    w = words(text) if w is None else w
    n = F.size(w)
    starts = F.sequence(F.lit(0), F.ceil((n - window) / stride).cast("int"))
    return F.when(n == 0, F.array().cast("array<string>")).when(n <= window, F.array(text)).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(w, i * stride + 1, window), " ")))


def date_prefix(snippet: Column) -> Column:
    """struct(date, rest) of a snippet such as "Jan 10, 2024 - text"."""
    s = F.trim(snippet)
    pattern = f"(?s)^(20\\d{{2}}-\\d{{2}}-\\d{{2}}|{tables.MONTHS}\\s+\\d{{1,2}},\\s+20\\d{{2}})\\s*[-—·|]\\s+(.+)$"
    rest = F.trim(F.regexp_extract(s, pattern, 2))
    return F.struct(F.when(rest != "", F.regexp_extract(s, pattern, 1)).alias("date"), F.when(rest != "", rest).otherwise(s).alias("rest"))


def published_at(text: Column) -> Column:
    """The first ISO date of this century's in a snippet, else the first with a month's name."""
    return F.coalesce(found(text, "\\b(20\\d{2}-\\d{2}-\\d{2})\\b", 1), found(text, f"\\b({tables.MONTHS}\\s+\\d{{1,2}},\\s+20\\d{{2}})\\b", 1))


def page_date(text: Column) -> Column:
    return F.coalesce(*[found(text, p) for p in tables.DATES])


def parsed_date(text: Column) -> Column:
    forms = ["yyyy-MM-dd", "MMM d, yyyy", "MMMM d, yyyy"]
    iso = F.to_date(F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")))
    return F.coalesce(iso, *[F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in forms[1:]])


def recency_bonus(day: Column, as_of: Column) -> Column:
    """0.05 for a future day, 0.25 within 30 days, 0.10 within a year, else and for null 0."""
    age = F.datediff(as_of, day)
    return F.when(age < 0, 0.05).when(age <= 30, 0.25).when(age <= 365, 0.10).otherwise(0.0)


# -- queries


def normalized_query(query: Column) -> Column:
    return F.lower(clean_text(query))


def topic(query: Column, entry_type: Column) -> Column:
    """The first five words of more than three bytes, in small letters."""
    w = F.slice(F.filter(words(query), lambda x: F.octet_length(x) > 3), 1, 5)
    return F.when(F.size(w) == 0, F.concat(F.lit("general_"), entry_type)).otherwise(F.lower(F.array_join(w, " ")))


def dev_words(query: Column) -> Column:
    """The developer words within a query, parts of other words too."""
    every = F.array(*[F.lit(w) for w in tables.DEV_WORDS])
    # the small letters are made once, not for each word
    return F.get(F.transform(F.array(F.lower(query)), lambda q: F.filter(every, lambda w: F.contains(q, w))), F.lit(0))


def is_developer_query(query: Column, hits: Column | None = None) -> Column:
    return _holds(query, hits, tables.DEV_WORDS + tables.DEV_PATTERNS)


#: What the functions of queries below look for, so that one pass can find it all.
QUERY_NEEDLES = [*dict.fromkeys([*tables.DEV_WORDS, *tables.DEV_PATTERNS, "docs", "documentation", "tutorial", "error", "bug", "stackoverflow", "error:", "error message", "how to", *tables.HOW_TO_LANGUAGES, "crate", "site:"])]
#: Developer words that have sites.
_WITH_SITES = [w for w in tables.DEV_WORDS if w in tables.SITES]


def query_hits(query: Column) -> Column:
    """The needles of a query, for the functions that take `hits`."""
    return N.hits(F.lower(query), QUERY_NEEDLES)


def _holds(query: Column, hits: Column | None, words: list[str]) -> Column:
    return has_any(F.lower(query), words) if hits is None else N.has(hits, words)


def sites(query: Column, hits: Column | None = None) -> Column:
    """Sites of the query's words, in order and once each; none for other queries."""
    if hits is None:
        q, none = F.lower(query), F.array().cast("array<string>")
        each = [F.when(F.contains(q, F.lit(w)), F.array(*[F.lit(s) for s in tables.SITES[w]])).otherwise(none) for w in _WITH_SITES]
        return F.array_distinct(F.concat(*each))
    own = F.filter(F.array(*[F.lit(w) for w in _WITH_SITES]), lambda w: F.array_contains(hits, w))
    of = F.create_map(*[x for w in _WITH_SITES for x in (F.lit(w), F.array(*[F.lit(s) for s in tables.SITES[w]]))])
    return F.array_distinct(F.flatten(F.transform(own, lambda w: F.element_at(of, w))))


def suggestions(query: Column, hits: Column | None = None, of: Column | None = None) -> Column:
    """hits and of: columns of query_hits(query) and sites(query), where they are known."""
    s = sites(query, hits) if of is None else of
    dev = is_developer_query(query, hits)
    words = F.size(dev_words(query)) > 0 if hits is None else N.has(hits, tables.DEV_WORDS)
    plain = dev & words & ~_holds(query, hits, ["docs", "documentation", "tutorial"])
    with_ = lambda tail: F.concat(query, F.lit(" "), tail)
    some = [
        F.when(plain, with_(F.lit("documentation"))),
        F.when(plain, with_(F.lit("tutorial"))),
        F.when(F.size(s) > 0, with_(F.concat(F.lit("site:"), F.get(s, F.lit(0))))),
        F.when(F.size(s) > 1, with_(F.concat(F.lit("site:"), F.get(s, F.lit(1))))),
        F.when(dev & _holds(query, hits, ["error", "bug"]) & ~_holds(query, hits, ["stackoverflow"]), with_(F.lit("site:stackoverflow.com"))),
    ]
    return F.filter(F.array(*some), lambda x: x.isNotNull())


def rewritten(query: Column, hits: Column | None = None, of: Column | None = None) -> Column:
    """The query with a site, where it is clear which; else null."""
    s = sites(query, hits) if of is None else of
    holds = lambda *words: _holds(query, hits, list(words))
    at = lambda site: F.concat(query, F.lit(" site:"), site)
    how_to = [(holds("how to") & holds(w), at(F.lit(tables.SITES[w][0]))) for w in tables.HOW_TO_LANGUAGES]
    cases = [
        (holds("docs", "documentation") & (F.size(s) > 0), at(F.get(s, F.lit(0)))),
        (holds("error:", "error message"), at(F.lit("stackoverflow.com"))),
        *how_to,
        (holds("crate"), at(F.lit("docs.rs"))),
    ]
    return F.when(is_developer_query(query, hits) & ~holds("site:"), first_match(cases))


def recovery_queries(query: Column, effective: Column, rewrite: Column | None = None, suggested: Column | None = None) -> Column:
    """What to try when nothing was found: the rewritten query and up to three suggestions."""
    rewrite = rewritten(query) if rewrite is None else rewrite
    suggested = suggestions(query) if suggested is None else suggested
    tried = F.concat(F.filter(F.array(rewrite), lambda x: x.isNotNull()), F.slice(suggested, 1, 3))
    return F.array_except(F.array_distinct(tried), F.array(query, effective))


def query_forms(rows: DataFrame, query: str) -> DataFrame:
    """rows with `rewritten`, `suggestions` and `recovery` of a column of queries: its words are looked for once."""
    q = F.col(query)
    d = rows.withColumn("_hits", query_hits(q)).withColumn("_sites", sites(q, F.col("_hits")))
    d = d.withColumns({"rewritten": rewritten(q, F.col("_hits"), F.col("_sites")), "suggestions": suggestions(q, F.col("_hits"), F.col("_sites"))})
    recovery = recovery_queries(q, F.coalesce("rewritten", q), F.col("rewritten"), F.col("suggestions"))
    return d.withColumn("recovery", recovery).drop("_hits", "_sites")


def research_queries(query: Column, most: int = 6) -> Column:
    """The query and its angles, without regard to case and spacing once each, `most` of them."""
    every = F.array(F.trim(query), *[F.concat(query, F.lit(" " + a)) for a in tables.RESEARCH_ANGLES])
    same = lambda a, b: normalized_query(a) == normalized_query(b)
    add = lambda have, q: F.when(F.exists(have, lambda h: same(h, q)), have).otherwise(F.concat(have, F.array(q)))
    return F.slice(F.aggregate(every, F.array().cast("array<string>"), add), 1, most)


def query_topic(query: Column) -> Column:
    q = F.lower(query)
    return first_match([(has_any(q, tables.CODE_WORDS), "code"), (has_any(q, tables.NEWS_WORDS), "news")], "general")


def wants_community(query: Column, results: Column, enabled: bool = True, threshold: int = 4) -> Column:
    return F.lit(enabled) & (has_any(F.lower(query), tables.COMMUNITY_WORDS) | (results < threshold))


def is_similar_query(a: Column, b: Column) -> Column:
    """Equal, one's words within the other's, or more than 70 % of words in common."""
    x, y = words(F.lower(a)), words(F.lower(b))
    within = (F.size(x) > 0) & (F.size(y) > 0) & ((F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0))
    common = F.size(F.filter(x, lambda t: F.array_contains(y, t))) / F.greatest(F.size(x), F.size(y), F.lit(1))
    return (F.lower(a) == F.lower(b)) | within | ((F.size(x) >= 2) & (F.size(y) >= 2) & (common > 0.7))


def byte_prefix(text: Column, most: int) -> Column:
    """The longest beginning of at most so many bytes that cuts no character."""
    cut = F.substring(text.cast("binary"), 1, most)
    # a character that is cut becomes a replacement character
    keep = F.make_valid_utf8(cut.cast("string"))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.regexp_replace(keep, "\\uFFFD+$", ""))


def paragraphs_within(paragraphs: Column, max_chars: int) -> Column:
    """The first paragraphs until their bytes, with four each besides, reach max_chars - 2000, 500 at least."""
    budget = max(500, max_chars - 2000)
    begin = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("kept"))
    step = lambda s, p: F.when(s["n"] >= budget, s).otherwise(F.struct((s["n"] + F.octet_length(p) + 4).alias("n"), F.concat(s["kept"], F.array(p)).alias("kept")))
    return F.aggregate(paragraphs, begin, step, lambda s: s["kept"])


def image_hints(images: Column, fallback: Column, most: int = 3) -> Column:
    """Markdown of the first images, array of struct(src, alt, title)."""
    label = lambda i: F.coalesce(F.nullif(i["alt"], F.lit("")), F.nullif(i["title"], F.lit("")), fallback)
    return F.transform(F.slice(images, 1, most), lambda i: F.concat(F.lit("!["), label(i), F.lit("]("), i["src"], F.lit(")")))
