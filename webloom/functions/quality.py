"""Scores and predicates over page rows: quality, block pages, login walls, kinds of content and page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import tables
from . import url as U
from .text import first_match, has_any, word_count


def extraction_score(words: Column, published: Column, code_blocks: Column, headings: Column) -> Column:
    """How much of a page was got, 0 to 1: length, date, code, headings."""
    w = words.cast("double")
    length = F.when(words.between(500, 2000), 0.15).when(words > 2000, 0.15 * 2000 / w).when(words > 100, 0.15 * w / 500).otherwise(0.0)
    score = (
        F.when(words > 50, 0.30).when(words > 20, 0.15).otherwise(0.0)
        + F.when(published.isNotNull(), 0.20).otherwise(0.0)
        + F.when(code_blocks > 0, 0.20).otherwise(0.0)
        + F.when(headings > 2, 0.15).when(headings >= 1, 0.075).otherwise(0.0)
        + length
    )
    return F.round(F.least(score, F.lit(1.0)), 6)


def noise_ratio(clean: Column, raw: Column) -> Column:
    """Share of the raw text that cleaning took away."""
    r = 1 - F.octet_length(clean) / F.octet_length(raw)
    return F.when(F.octet_length(raw) == 0, 0.0).otherwise(F.least(F.greatest(r, F.lit(0.0)), F.lit(1.0)))


def reading_minutes(words: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(words / 200)).cast("long")


def serp_block_reason(status: Column, body: Column) -> Column:
    b = F.lower(body)
    cases = [(status == s, v) for s, v in tables.SERP_STATUS.items()]
    cases += [(F.contains(b, F.lit(n)), v) for n, v in tables.SERP_BLOCKS.items()]
    return first_match([*cases, ((F.octet_length(body) < 3500) & F.contains(b, F.lit("blocked")), "block_page")], F.lit(None).cast("string"))


def block_reason(html: Column) -> Column:
    """Why a page is none, or null.  Of very large pages only the beginning counts, and few of the signs."""
    h = F.lower(html)
    start = F.substring(h, 1, 10_000)
    captchas = F.regexp_count(start, F.lit("captcha"))
    large = first_match(
        [
            (has_any(start, tables.PAGE_BLOCKS["Human Verification"]), "Human Verification"),
            (has_any(start, tables.PAGE_BLOCKS["Access Denied"]), "Access Denied"),
            (captchas > 2, "Captcha"),
        ],
        F.lit(None).cast("string"),
    )
    small = [(has_any(h, needles), label) for label, needles in tables.PAGE_BLOCKS.items()]
    small += [(has_any(h, needles) & (F.octet_length(html) < 5000), label) for label, needles in tables.SMALL_BLOCKS.items()]
    return F.when(F.octet_length(html) > 500_000, large).otherwise(first_match(small, F.lit(None).cast("string")))


def is_spa(html: Column) -> Column:
    return has_any(html, tables.SPA_MARKERS)


def content_kind(url: Column, html: Column) -> Column:
    """Kind of content by address and the first 50 000 characters."""
    h, p, peek = F.coalesce(U.host(url), F.lit("")), F.lower(U.path(url)), F.substring(html, 1, 50_000)
    return first_match(
        [
            (has_any(h, tables.CODE_HOSTS + tables.QA_HOSTS + tables.PASTE_HOSTS) | has_any(p, tables.CODE_PATHS), "CodeRepository"),
            (peek.rlike("^\\s*[{\\[]"), "ApiResponse"),
            (has_any(peek, tables.SPA_SIGNS), "SinglePageApp"),
            (has_any(h, tables.SHOP_HOSTS) | has_any(peek, tables.SHOP_SIGNS), "ECommerce"),
            (has_any(peek, tables.ARTICLE_SIGNS), "NewsArticle"),
        ],
        "Unknown",
    )


def _auth_pair(text: Column) -> Column:
    pairs = [F.contains(text, F.lit(a)) & F.contains(text, F.lit(b)) for a, b in tables.AUTH_PAIRS]
    return (word_count(text) < 80) & (pairs[0] | pairs[1] | pairs[2])


def is_auth_wall(content: Column) -> Column:
    """Whether the text asks for a login instead of showing something."""
    c = F.lower(content)
    return has_any(c, tables.AUTH_PHRASES) | _auth_pair(c)


def auth_factors(html: Column, content: Column, url: Column) -> Column:
    """Signs of a login page with their weights: array of struct(factor, weight)."""
    c, h = F.lower(content), F.lower(html)
    phrase, pair = has_any(c, tables.AUTH_PHRASES), _auth_pair(c)
    words = word_count(content)
    start = F.substring(h, 1, 60_000)
    looks = has_any(start, ["password", "sign in", "login"])
    attribute = lambda name, value: html.rlike(f"(?i)<[^>]*\\s{name}\\s*=\\s*[\"']?([^\"'>]*\\s)?{value}(\\s[^\"'>]*)?[\"'\\s>]")
    element = looks & F.coalesce(sum_or([attribute(n, v) for n, v in tables.AUTH_ELEMENTS.values()]), F.lit(False))
    action = looks & h.rlike("<form[^>]*\\saction\\s*=\\s*[\"']?[^\"'\\s>]*(" + "|".join(tables.AUTH_ACTIONS) + ")")
    title = looks & F.lower(F.trim(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))).rlike(tables.AUTH_TITLE)
    navs = F.regexp_count(F.substring(h, 1, 30_000), F.lit("<nav|role=\"navigation\""))
    before = F.when(phrase, 0.55).otherwise(0.0) + F.when(pair, 0.25).when((words < 80) & ~phrase, 0.05).otherwise(0.0) + F.when(element, 0.50).otherwise(0.0)
    factor = lambda condition, name, weight: F.when(condition, F.struct(F.lit(name).alias("factor"), (weight if isinstance(weight, Column) else F.lit(weight)).alias("weight")))
    every = [
        factor(phrase, "high_confidence_auth_keyword", 0.55),
        factor(pair, "short_content_with_auth_signals", 0.25),
        factor(~pair & (words < 80) & ~phrase, "very_short_content", 0.05),
        factor(element, "dom_login_selector", 0.50),
        factor(action, "dom_auth_form_action", F.when(before < 0.50, 0.40).otherwise(0.0)),
        factor(title, "auth_page_title", 0.35),
        factor((navs > 1) & (words < 100), "high_nav_density", 0.12),
        factor(has_any(F.lower(url), tables.AUTH_URLS), "auth_url_pattern", 0.20),
    ]
    return F.filter(F.array(*every), lambda f: f.isNotNull())


def sum_or(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def auth_risk(factors: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.aggregate(factors, F.lit(0.0), lambda a, f: a + f["weight"])), 6)


def page_type(url: Column, title: Column, content: Column, headings: Column, words: Column, published: Column) -> Column:
    u, t = F.lower(url), F.lower(title)
    return first_match(
        [
            (u.endswith("/") & (headings == 0) & (words < 80), "landing_page"),
            (has_any(u, ["/docs", "/learn"]) | has_any(t, ["documentation", "guide", "learn"]), "documentation"),
            (has_any(u, ["/blog", "/news"]) | published.isNotNull(), "article"),
            (has_any(u, ["/product", "/pricing"]) | F.contains(content, F.lit("Add to cart")), "product"),
            (u.endswith("/") | F.contains(t, F.lit("home")), "homepage"),
        ],
        "webpage",
    )


def match_band(score: Column) -> Column:
    return first_match([(score >= 0.9, "Exact"), (score >= 0.7, "High"), (score >= 0.5, "Partial")], "Low")


def skips_fetch(entry_type: Column, score: Column, words: Column, warnings: Column) -> Column:
    """Whether a remembered page is good enough to use as it is."""
    sparse = F.exists(warnings, lambda w: w.isin("short_content", "content_restricted"))
    return (entry_type == "scrape") & (score >= 0.6) & (words >= 50) & ~F.coalesce(sparse, F.lit(False))


def backoff_seconds(base: Column, streak: Column, cap: Column) -> Column:
    """base, doubled for each failure after the first, four times at most, up to cap."""
    return F.least(base * F.pow(F.lit(2), F.least(F.greatest(streak - 1, F.lit(0)), F.lit(4))), cap).cast("long")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, -1 to 1; 0 if they are empty, of other lengths, or one is zero or holds what is no number."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda x: F.sqrt(total(F.transform(x, lambda v: v.cast("double") * v.cast("double"))))
    n = norm(a) * norm(b)
    odd = (F.size(a) != F.size(b)) | (F.size(a) == 0) | (n == 0) | F.isnan(n) | (n == float("inf")) | F.isnan(dot)
    return F.when(F.coalesce(odd, F.lit(True)), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / n)))


def is_grounded(value: Column, source: Column, lowered: bool = False) -> Column:
    """Whether a value stands in its source: as it is, or 70 % of its words of three bytes and more.

    lowered: the source is in small letters; a long one is better lowered once, in a column of its own.
    """
    v, s = F.lower(F.trim(value)), source if lowered else F.lower(source)
    w = F.filter(F.split(v, "[^\\p{IsAlphabetic}\\p{N}]+"), lambda x: F.octet_length(x) >= 3)
    part = F.size(F.filter(w, lambda x: F.contains(s, x))) / F.greatest(F.size(w), F.lit(1))
    return (F.octet_length(v) < 4) | F.contains(s, v) | (F.size(w) == 0) | (part >= 0.70)


def has_challenge(html: Column) -> Column:
    return has_any(F.lower(html), tables.CHALLENGES)


def preflight(status: Column, html: Column) -> Column:
    """struct(status, words, reason, rejected) of a first look at a page."""
    from .text import html_text

    reason = block_reason(html)
    return F.struct(status.alias("status"), word_count(html_text(html)).alias("words"), reason.alias("reason"), (reason.isNotNull() | (status >= 400)).alias("rejected"))


def is_high_noise(text: Column) -> Column:
    """Whether ten lines or more are mostly short ones and controls."""
    lines = F.transform(F.split(text, "\\r?\\n"), lambda x: F.trim(x))
    control = lambda x: (F.octet_length(x) < 40) & has_any(F.lower(x), tables.CONTROL_WORDS)
    noise = F.size(F.filter(lines, lambda x: (F.octet_length(x) < 10) | control(x)))
    chars = F.aggregate(F.filter(lines, lambda x: F.octet_length(x) >= 10), F.lit(0), lambda a, x: a + F.octet_length(x))
    return (F.size(lines) >= 10) & ((noise / F.size(lines) > 0.6) | (F.floor(chars / F.size(lines)) < 20))


def engine_timeout_ms(engine: Column) -> Column:
    return F.greatest(F.lit(tables.ENGINE_TIMEOUT_LEAST), first_match([(engine == e, ms) for e, ms in tables.ENGINE_TIMEOUTS.items()], tables.ENGINE_TIMEOUT))


def is_media(resource: Column) -> Column:
    return F.lower(resource).isin("media", "font")
