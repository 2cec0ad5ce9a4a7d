"""URLs: keys, parts, classes and weights.  A URL that can't be read gives what each function says, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import tables
from .text import first_match, found, has_any


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def is_http(url: Column) -> Column:
    return F.coalesce(url.rlike("^https?://"), F.lit(False))


def search_key(url: Column) -> Column:
    """The URL without fragment and tracking parameters, the others sorted; case is kept."""
    u = F.trim(url)
    base, query = F.regexp_extract(u, "^[^?#]*", 0), F.regexp_extract(u, "^[^?#]*\\?([^#]*)", 1)
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.startswith(name(p), F.lit(tables.TRACKING_PREFIX)) & ~name(p).isin(tables.TRACKING)))
    full = F.transform(kept, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))
    return F.when(host(u).isNull(), u).otherwise(F.concat(base, F.when(F.size(full) > 0, F.concat(F.lit("?"), F.array_join(full, "&"))).otherwise(F.lit(""))))


def crawl_key(url: Column) -> Column:
    """Small letters, no fragment, no query of empty values only, no slash at the end."""
    no_fragment = F.regexp_replace(url, "#.*$", "")
    query = F.regexp_extract(no_fragment, "\\?(.*)$", 1)
    empty = F.forall(F.split(query, "&"), lambda p: F.regexp_extract(p, "=(.*)$", 1) == "")
    u = F.when(empty, F.regexp_replace(no_fragment, "\\?.*$", "")).otherwise(no_fragment)
    return F.lower(F.regexp_replace(u, "/$", ""))


def resolved(base: Column, href: Column) -> Column:
    """href seen from base, or null if it is no page: absolute, protocol-relative, rooted and relative links."""
    h = F.trim(href)
    scheme, origin = found(base, "^([a-zA-Z]+:)//", 1), found(base, "^[a-zA-Z]+://[^/?#]+")
    folder = F.regexp_replace(F.regexp_extract(base, "^[a-zA-Z]+://[^/?#]+[^?#]*", 0), "(^[a-zA-Z]+://[^/?#]+)$", "$1/")
    cases = [
        (h.rlike("(?i)^(javascript:|mailto:|tel:|data:|#)") | (h == ""), F.lit(None).cast("string")),
        (h.rlike("(?i)^https?://"), h),
        (h.rlike("^//"), F.concat(scheme, h)),
        (h.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None).cast("string")),
        (h.rlike("^/"), F.concat(origin, h)),
        (h.rlike("^\\?"), F.concat(F.regexp_extract(base, "^[^?#]*", 0), h)),
    ]
    return first_match(cases, F.concat(F.regexp_replace(folder, "[^/]*$", ""), F.regexp_replace(h, "^\\./", "")))


def source_type(url: Column) -> Column:
    """What kind of site it is, by its host."""
    h = F.coalesce(host(url), F.lit(""))
    cases = [(has_any(h, needles) | (h.endswith(tables.DOCS_SUFFIX) if kind == "docs" else F.lit(False)), kind) for kind, needles in tables.SOURCE_TYPES.items()]
    return first_match(cases, "other")


def breadcrumbs(url: Column) -> Column:
    """Host and the first three parts of the path; empty if the URL can't be read."""
    parts = F.slice(F.filter(F.split(path(url), "/"), lambda p: F.trim(p) != ""), 1, 3)
    return F.when(host(url).isNull(), F.array().cast("array<string>")).otherwise(F.concat(F.array(host(url)), parts))


def has_high_value_crumb(crumbs: Column) -> Column:
    return F.exists(crumbs, lambda c: has_any(F.lower(c), tables.HIGH_VALUE_CRUMBS))


def domain_weight(domain: Column, kind: Column, topic: Column) -> Column:
    """Trust in a site, 0.1 to 3: by its kind, then by what its host says, one factor for each sign."""
    d = F.coalesce(F.lower(domain), F.lit(""))
    times = lambda condition, factor: F.when(condition, factor).otherwise(1.0)
    w = first_match([(kind == k, v) for k, v in tables.TYPE_WEIGHTS.items()], 1.0)
    for condition, factor in [
        (d.rlike("\\.(gov|edu)$"), 1.50),
        (F.contains(d, F.lit("ietf.org")), 1.50),
        (F.contains(d, F.lit("w3.org")), 1.50),
        (F.contains(d, F.lit("rust-lang.org")), 1.35),
        (d.endswith("learn.microsoft.com"), 1.25),
        (F.contains(d, F.lit("wikipedia.org")), 1.30),
        ((topic == "code") & has_any(d, ["github.com", "stackoverflow.com"]), 1.25),
        ((topic == "code") & F.contains(d, F.lit("docs.rs")), 1.30),
        ((topic == "news") & has_any(d, ["reuters.com", "apnews.com"]), 1.25),
        ((topic == "news") & has_any(d, ["bbc.co", "bbc.com"]), 1.10),
        (has_any(d, ["pinterest.", "facebook.", "tiktok."]), 0.60),
        (F.contains(d, F.lit("medium.com")), 0.95),
        (has_any(d, ["doubleclick.net", "googleadservices.com", "googlesyndication.com"]), 0.10),
    ]:
        w = w * times(condition, factor)
    return F.least(F.greatest(w, F.lit(0.10)), F.lit(3.0))


def domain_priority(url: Column) -> Column:
    u = F.lower(url)
    cases = [(F.contains(u, F.lit(n)), v) for n, v in tables.DOMAIN_PRIORITY.items()]
    return first_match([*cases, (has_any(u, tables.LOW_PRIORITY), -5)], 0)


def clean_content_url(url: Column) -> Column:
    """Where the plain text of a repository page is: of a file, or of the README; else null."""
    blob = F.regexp_replace(url, "^(https?://)(?:www\\.)?github\\.com(/[^/]+/[^/]+)/blob(/.*)$", "$1raw.githubusercontent.com$2$3")
    repo = F.regexp_replace(url, "^https?://github\\.com/([^/?#]+)/([^/?#]+)$", "https://raw.githubusercontent.com/$1/$2/HEAD/README.md")
    return first_match([(blob != url, blob), (repo != url, repo)], F.lit(None).cast("string"))


def plain_view_url(url: Column) -> Column:
    """The same repository page with plain=1, or null where that is no use."""
    fits = (host(url) == "github.com") & ~F.contains(path(url), F.lit("/blob/")) & ~url.rlike("[?&]plain=1(&|#|$)")
    base, fragment = F.regexp_extract(url, "^[^#]*", 0), F.regexp_extract(url, "#.*$", 0)
    return F.when(fits, F.concat(base, F.when(F.contains(base, F.lit("?")), F.lit("&")).otherwise(F.lit("?")), F.lit("plain=1"), fragment))


def domain(url: Column) -> Column:
    return F.coalesce(host(url), F.lit("unknown"))


def code_language(url: Column) -> Column:
    """Programming language by the file's extension, or null."""
    extension = F.lower(F.regexp_extract(path(url), "\\.([A-Za-z0-9]+)$", 1))
    return first_match([(extension == e, v) for e, v in tables.CODE_EXTENSIONS.items()], F.lit(None).cast("string"))


def is_raw_content(url: Column) -> Column:
    return F.lower(F.regexp_extract(path(url), "\\.([A-Za-z0-9]+)$", 1)).isin(tables.RAW_EXTENSIONS)


def domain_key(url: Column) -> Column:
    return F.translate(host(url), ".:", "__")


def parent_key(host_name: Column) -> Column:
    """Key of the domain above, or null if that would be a top-level one."""
    parent = F.regexp_replace(host_name, "^[^.]+\\.", "")
    return F.when(F.contains(parent, F.lit(".")) & (parent != host_name), F.translate(parent, ".:", "__"))


def is_ad(url: Column, media: bool = False) -> Column:
    ad = has_any(url, tables.AD_URLS)
    return ad | has_any(F.lower(url), tables.MEDIA_EXTENSIONS) if media else ad


def should_crawl(url: Column, base_domain: Column, same_domain: bool = True, strict: bool = False, exclude: list[str] = (), include: list[str] = ()) -> Column:
    """Whether a link is followed: its domain ends with the base's (strict: is it or below it), none excluded, one included."""
    h = host(url)
    ends = (h == base_domain) | F.endswith(h, F.concat(F.lit("."), base_domain)) if strict else F.endswith(h, base_domain)
    ok = h.isNotNull() & (ends if same_domain else F.lit(True))
    if exclude:
        ok &= ~has_any(F.lower(url), [e.lower() for e in exclude])
    if include:
        ok &= has_any(F.lower(url), [e.lower() for e in include])
    return F.coalesce(ok, F.lit(False))


def unwrapped_bing(href: Column) -> Column:
    """Target of a result link: /ck/?u=a1<base64 of the URL>; a plain URL is its own."""
    packed = found(href, "[?&]u=a1([A-Za-z0-9_=-]+)", 1)
    padded = F.concat(F.translate(packed, "-_", "+/"), F.substring(F.lit("==="), 1, F.pmod(-F.length(packed), F.lit(4)).cast("int")))
    return F.coalesce(F.try_to_binary(padded, F.lit("base64")).cast("string"), F.when(is_http(href), href))


def unwrapped_duckduckgo(href: Column) -> Column:
    full = F.when(href.rlike("^//"), F.concat(F.lit("https:"), href)).otherwise(href)
    return F.coalesce(F.try_url_decode(found(full, "[?&]uddg=([^&#]+)", 1)), F.when(is_http(full), full))


def unwrapped_google(href: Column) -> Column:
    target = F.when(href.rlike("^(https?://[^/]*google\\.[^/]+)?/url\\?"), F.try_url_decode(found(href, "[?&]q=([^&#]+)", 1)))
    return F.coalesce(target, F.when(is_http(href), href))


def masked_credentials(url: Column) -> Column:
    return F.regexp_replace(url, "^([a-zA-Z0-9+.-]+://[^:/@]+):[^@/]*@", "$1:***@")


def host_port(value: Column) -> Column:
    """struct(host, port) of host:port, or null."""
    h, p = found(value, "^(.+):(\\d+)$", 1), found(value, "^(.+):(\\d+)$", 2).try_cast("int")
    return F.when(h.isNotNull() & p.between(0, 65535), F.struct(h.alias("host"), p.alias("port")))


def scheme_by_port(port: Column) -> Column:
    return first_match([(port.isin(443, 8443), "https"), (port.isin(1080, 1081, 1082, 1085, 1086, 1088, 10800, 10808, 10809, 9050, 9150, 4145), "socks5")], "http")




def is_tutorial(url: Column) -> Column:
    h, p = F.coalesce(host(url), F.lit("")), F.lower(path(url))
    return has_any(h, tables.TUTORIAL_HOSTS) | h.startswith(tables.TUTORIAL_PREFIXES[0]) | h.startswith(tables.TUTORIAL_PREFIXES[1]) | has_any(p, tables.TUTORIAL_PATHS)


def needs_browser(url: Column) -> Column:
    h = F.coalesce(host(url), F.lit(""))
    return has_any(h, tables.BROWSER_HOSTS) | (h == tables.BROWSER_DOMAIN) | h.endswith("." + tables.BROWSER_DOMAIN)


def browser_first(url: Column, quality: str = "balanced", proxy: bool = False, app_state: bool = False) -> Column:
    """Whether a page should come from a browser's rendering: for a proxy, for page state, for high quality, for some sites."""
    return F.lit(True) if proxy or app_state or quality in ("aggressive", "high") else needs_browser(url)
