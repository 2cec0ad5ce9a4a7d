"""A small HTML tree and what is read from it: metadata, headings, links, images, code, embedded data, text.

Plain Python over one page at a time; sources.pages runs it in Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

from .. import tables

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements whose text is none of the page's.
SILENT = {"script", "style", "noscript", "svg", "canvas", "iframe", "nav", "header", "footer", "aside", "form", "button", "template", "head"}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that end an open paragraph, and those that may be open within it.
ENDS_P = {"p", "div", "section", "article", "main", "ul", "ol", "table", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "form", "dl", "aside", "nav", "header", "footer"}
INLINE = {"b", "i", "em", "strong", "a", "span", "u", "s", "small", "code", "sub", "sup", "font", "mark"}
BLOCK = {"p", "div", "section", "article", "main", "li", "ul", "ol", "tr", "table", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "br", "dt", "dd", "body"}


class Node:
    __slots__ = ("attrs", "children", "nodes", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.nodes: list[Node] | None = None

    def walk(self) -> list[Node]:
        """This node and those below it, in order; listed once, as trees do not change when they are read."""
        if self.nodes is None:
            self.nodes, stack = [], [self]
            while stack:
                node = stack.pop()
                self.nodes.append(node)
                stack += [c for c in reversed(node.children) if isinstance(c, Node)]
        return self.nodes

    def all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def first(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)

    def get(self, name: str) -> str:
        return self.attrs.get(name, "")

    def classes(self) -> list[str]:
        return self.get("class").split()

    def raw_text(self) -> str:
        out: list[str] = []
        stack: list = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack.extend(reversed(node.children))
        return "".join(out)

    def text(self) -> str:
        return " ".join(self.raw_text().split())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        closes = CLOSES.get(tag, ())
        if self.at.tag in closes:
            self.at = self.at.parent
        elif tag in ENDS_P:
            above = self.at
            while above.tag in INLINE and above.parent is not None:
                above = above.parent
            if above.tag == "p":
                self.at = above.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        kids = self.at.children
        if kids and isinstance(kids[-1], str):  # the reader may cut a text
            kids[-1] += data
        else:
            kids.append(data)


#: An ampersand of no whole reference of some names, outside of elements whose text has none.
_BARE = r"(?is)(<(script|style)\b.*?</\2)|&(?!(?:{});)"


def parse(html: str, only: str = r"#?\w+") -> Node:
    """The tree of a page; references without their semicolon, as cut texts end with, are text, and so are those whose names `only` doesn't match."""
    b = _Builder()
    try:
        b.feed(re.sub(_BARE.format(only), lambda m: m[1] or "&amp;", html) if "&" in html else html)
        b.close()
    except (AssertionError, ValueError):
        pass  # what was read so far stays
    return b.root


def words(text: str) -> int:
    return len(text.split())


# -- metadata


def meta(root: Node, *names: str) -> str | None:
    """Content of the first meta element of these names that has some."""
    for name in names:
        for m in root.all("meta"):
            if name in (m.get("name"), m.get("property"), m.get("http-equiv").lower()) and m.get("content").strip():
                return m.get("content").strip()
    return None


def title(root: Node) -> str:
    for tag in ("title", "h1"):
        node = root.first(tag)
        if node is not None and node.text():
            return node.text()
    return "No Title"


def canonical(root: Node, base: str) -> str | None:
    return next((urljoin(base, n.get("href")) for n in root.all("link") if "canonical" in n.get("rel").split() and n.get("href")), None)


# Frequent words by which a language is told, where the page does not say.
STOP_WORDS = {
    "en": "the of and to in is that for it with",
    "de": "der die und in den von zu das mit sich",
    "fr": "le de un et la les des est que dans",
    "es": "el la de que y en los se del las",
    "it": "il di che la e un per non sono con",
    "pt": "o de que e do da em um para os",
    "nl": "de het een van en in is dat op te",
}


def language(root: Node) -> str:
    html = root.first("html")
    if html is not None and "lang" in html.attrs:
        return html.get("lang")
    if said := meta(root, "content-language"):
        return said
    seen = main_text(root).lower().split()
    scores = {lang: sum(w in stop for w in seen) for lang, stop in ((k, set(v.split())) for k, v in STOP_WORDS.items())}
    best = max(scores, key=scores.get)
    return best if scores[best] else "unknown"


def headings(root: Node) -> list[dict]:
    """By level, not by place."""
    return [{"level": f"h{i}", "text": n.text()} for i in range(1, 7) for n in root.all(f"h{i}") if n.text()]


def _absolute(base: str, href: str) -> str | None:
    href = href.strip()
    if not href or href.lower().startswith(("#", "javascript:", "mailto:", "tel:", "data:")):
        return None
    try:
        url = urljoin(base, href)
        return url if urlsplit(url).scheme in ("http", "https") else None
    except ValueError:
        return None


def _links(nodes: list[Node], base: str) -> list[dict]:
    out: dict[str, dict] = {}
    for n in nodes:
        if "href" in n.attrs and (url := _absolute(base, n.get("href"))):
            out.setdefault(url, {"url": url, "text": n.text()})
    return list(out.values())


def content_links(root: Node, base: str) -> list[dict]:
    """Links of the first main part that has three, else of the page; each address once."""
    parts = [lambda n: n.tag == "article", lambda n: n.tag == "main", lambda n: n.get("role") == "main"]
    parts += [lambda n, c=c: c in n.classes() for c in ("post-content", "entry-content", "article-body", "markdown-body", "content")]
    parts += [lambda n: n.get("id") == "content"]
    for fits in parts:
        found = _links([a for n in root.walk() if fits(n) for a in n.all("a")], base)
        if len(found) >= 3:
            return found
    return _links(root.all("a"), base)


def images(root: Node, base: str) -> list[dict]:
    out: dict[str, dict] = {}
    for n in root.all("img"):
        if n.get("src") and (url := _absolute(base, n.get("src"))):
            out.setdefault(url, {"src": url, "alt": n.get("alt"), "title": n.get("title")})
    return list(out.values())


# -- code


def _code_language(*nodes: Node) -> str | None:
    for n in nodes:
        for c in n.classes():
            if m := re.fullmatch(r"(?:language|lang|highlight-source|brush)[-:](\w+)", c):
                return m[1].lower()
    return None


IMPORTS = {
    "python": r"^(?:import\s|from\s+\S+\s+import\b)",
    "rust": r"^(?:pub\s+)?(?:use\s|extern\s+crate\s)",
    "javascript": r"^(?:import\s|export\s+\*\s+from\b|(?:const|let|var)\s+.*=\s*require\()",
    "typescript": r"^(?:import\s|export\s+\*\s+from\b)",
    "java": r"^(?:import\s|package\s)",
    "go": r"^(?:import\s|package\s)",
    "c": r"^#\s*include\b",
}


def without_imports(code: str, lang: str | None) -> str:
    """Code of 15 lines and more without a leading block of imports that is a good part of it; notes to do stay."""
    lines = code.split("\n")
    pattern = IMPORTS.get({"js": "javascript", "ts": "typescript", "py": "python", "rs": "rust", "cpp": "c", "kotlin": "java"}.get(lang or "", lang or ""))
    if len(lines) < 15 or not pattern:
        return code
    n, last = 0, -1
    for i, line in enumerate(lines):
        if re.match(pattern, line.strip()):
            n, last = n + 1, i
        elif line.strip() and not line.lstrip().startswith(("//", "#", "/*", "*")):
            break
    share = (last + 1) / len(lines)
    if not (n >= 3 and share > 0.30 or n >= 1 and share > 0.10):
        return code
    kept = [x for x in lines[: last + 1] if re.search(r"(?i)todo|fixme", x)]
    return "\n".join(kept + lines[last + 1 :]).strip("\n")


def code_blocks(root: Node, url: str = "", tutorial: bool = False) -> list[dict]:
    """Preformatted blocks of ten bytes and more, then long or many-lined code elements; each (language, code) once."""
    hint = tables.CODE_EXTENSIONS.get(urlsplit(url).path.rpartition(".")[2].lower()) if url else None
    out: dict[tuple, dict] = {}
    for n in root.all("pre", "code"):
        inside = n.parent
        while inside is not None and inside.tag != "pre":
            inside = inside.parent
        if n.tag == "code" and inside is not None:
            continue
        inner = n.first("code") or n
        text = n.raw_text().strip("\n")
        if len(text.encode()) < 10 or n.tag == "code" and not ("\n" in text or len(text) > 60):
            continue
        lang = _code_language(inner, n) or hint
        code = text if tutorial else without_imports(text, lang)
        out.setdefault((lang, code), {"language": lang, "code": code})
    return list(out.values())


# -- embedded data


def _scripts(root: Node) -> Iterator[tuple[Node, str]]:
    for n in root.all("script"):
        if text := n.raw_text().strip():
            yield n, text


def _json(text: str) -> object | None:
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def embedded_sources(root: Node, least: int = 1000) -> list[dict]:
    """All linked data, and other JSON scripts of more than `least` bytes; each content once."""
    out: dict[str, dict] = {}
    for n, text in _scripts(root):
        kind = n.get("type").lower()
        if _json(text) is None:
            continue
        if "ld+json" in kind:
            out.setdefault(text, {"source_type": "json-ld", "content": text})
        elif len(text.encode()) > least:
            out.setdefault(text, {"source_type": n.get("id") or "json", "content": text})
    return list(out.values())


def state_json(root: Node) -> str | None:
    """The largest JSON script: from 200 bytes if its id tells that it is a page's state, else from 800."""
    found = []
    for n, text in _scripts(root):
        hinted = any(s in n.get("id") + text[:200] for s in tables.SPA_MARKERS)
        if "ld+json" not in n.get("type") and len(text.encode()) >= (200 if hinted else 800) and _json(text) is not None:
            found.append((hinted, len(text), text))
    return max(found)[2] if found else None


def ld_text(value: object) -> str | None:
    """Text of a scalar, of the first of a list, of an object's name."""
    if isinstance(value, list):
        value = value[0] if value else None
    if isinstance(value, dict):
        value = value.get("name")
    if value is None or isinstance(value, dict | list):
        return None
    return str(value).lower() if isinstance(value, bool) else str(value)


def _ld_price(value: object) -> str | None:
    if isinstance(value, list):
        return next((p for v in value if (p := _ld_price(v))), None)
    if isinstance(value, dict):
        return next((p for k in ("price", "lowPrice", "highPrice") if (p := ld_text(value.get(k)))), None) or _ld_price(value.get("offers"))
    return None


def _ld_names(value: object) -> str | None:
    return ", ".join(n for v in (value if isinstance(value, list) else [value]) if (n := ld_text(v))) or None


def _ld_address(value: object) -> str | None:
    if isinstance(value, dict):
        return ", ".join(p for k in ("streetAddress", "addressLocality", "addressRegion", "postalCode") if (p := ld_text(value.get(k)))) or None
    return ld_text(value)


# Kinds of linked data and what is shown of each.
LD_KINDS = {
    "Product": [("Product", "name"), ("Description", "description"), ("Price", "offers"), ("Brand", "brand")],
    "Article": [("Title", "headline"), ("Author", "author"), ("Published", "datePublished"), ("Description", "description"), ("Text", "articleBody")],
    "NewsArticle": [("Title", "headline"), ("Author", "author"), ("Published", "datePublished"), ("Description", "description"), ("Text", "articleBody")],
    "BlogPosting": [("Title", "headline"), ("Author", "author"), ("Published", "datePublished"), ("Description", "description"), ("Text", "articleBody")],
    "RealEstateListing": [("Listing", "name"), ("Address", "address"), ("Price", "offers"), ("Description", "description")],
}


def _ld_render(value: object) -> Iterator[str]:
    if isinstance(value, list):
        for v in value:
            yield from _ld_render(v)
    elif isinstance(value, dict):
        kind = value.get("@type")
        kind = kind[0] if isinstance(kind, list) and kind else kind
        if kind in LD_KINDS:
            special = {"offers": _ld_price, "author": _ld_names, "address": _ld_address}
            lines = [f"{label}: {text}" for label, key in LD_KINDS[kind] if (text := special.get(key, ld_text)(value.get(key)))]
            if lines:
                yield "\n".join(lines)
        elif kind and (name := ld_text(value.get("name"))):
            yield f"{kind}: {name}"
        yield from _ld_render(value.get("@graph"))


def linked_data(root: Node) -> str | None:
    parts = [p for n, text in _scripts(root) if "ld+json" in n.get("type").lower() for p in _ld_render(_json(text))]
    return "\n---\n".join(parts) or None


def hosted_file(value: object) -> str | None:
    """Text of a file, issue or discussion in a code host's page state: the first that is there."""
    p = value.get("payload", value) if isinstance(value, dict) else {}
    for keys in (("blob", "text"), ("blob", "richText"), ("blob", "rawUrl"), ("readme", "richText"), ("issue", "body"), ("pullRequest", "body"), ("discussion", "body")):
        at = p
        for k in keys:
            at = at.get(k) if isinstance(at, dict) else None
        if isinstance(at, str) and at.strip():
            return at
    return None


# Keys of page state that hold no content.
NO_CONTENT_KEYS = {"id", "uuid", "hash", "buildId", "nonce", "token", "csrf", "className", "style", "href", "src", "icon", "locale"}


def flattened(value: object, prefix: str = "", depth: int = 0, limit: int = 400) -> list[str]:
    """JSON as lines `path: value`: six levels, 400 lines at most, without keys and values that say nothing."""
    out: list[str] = []

    def visit(v: object, path: str, level: int) -> None:
        if level > 6 or len(out) >= limit:
            return
        if isinstance(v, dict):
            for k in sorted(v):
                if k not in NO_CONTENT_KEYS and not (k.startswith("__") and k.endswith("__")):
                    visit(v[k], f"{path}.{k}" if path else k, level + 1)
        elif isinstance(v, list):
            if v and all(isinstance(x, str) for x in v):
                out.append(f"{path}: {', '.join(v[:20])}")
            else:
                for i, x in enumerate(v[:5]):
                    visit(x, f"{path}.{i}", level + 1)
        elif isinstance(v, str):
            encoded = len(v) >= 200 and sum(not (c.isalnum() or c in "=+/-_") for c in v) / len(v) < 0.05
            if v.strip() and not encoded and not re.fullmatch(r"[0-9a-f]{16,}", v):
                out.append(f"{path}: {v.strip()}")
        elif v is not None:
            out.append(f"{path}: {json.dumps(v)}")

    visit(value, prefix, depth)
    return out[:limit]


def state_text(root: Node) -> str | None:
    """Readable text of a page that keeps its content in JSON."""
    state = state_json(root)
    if state is None:
        return None
    value = _json(state)
    return hosted_file(value) or "\n".join(flattened(value)) or None


# -- main text


def _noise(n: Node) -> bool:
    name = f"{n.get('id')} {n.get('class')}".lower()
    return bool(name.strip()) and (any(x in name for x in tables.NOISE_IDENTIFIERS) or any(x in name for x in tables.NOISE_EDGES))


def _sparse(n: Node) -> bool:
    """Whether a container is controls rather than text; amounts of money are text."""
    if n.tag not in ("div", "section", "span"):
        return False
    text = n.text()
    if words(text) >= 25 or re.search(r"[$€£¥₹]\s?\d", text):
        return False
    return sum(1 for _ in n.all("a", "button", "input", "select")) >= 3


def block_text(root: Node, runs: bool = False) -> list[str]:
    """Text of a tree by blocks, without silent, noisy and sparse parts and, unless `runs` stay, without short lines that repeat more than three times."""
    lines: list[str] = []
    at: list[str] = []

    def flush() -> None:
        line = " ".join("".join(at).split())
        if line:
            lines.append(line)
        at.clear()

    stack: list = [(root, False)]
    while stack:
        node, done = stack.pop()
        if isinstance(node, str):
            at.append(node)
        elif done:
            flush()
        elif node.tag not in SILENT and not (node.tag not in ("body", "html", "article", "main") and _noise(node)) and not _sparse(node):
            if node.tag in BLOCK:
                flush()
                stack.append((node, True))
            stack.extend((c, False) for c in reversed(node.children))
    flush()
    out, run = [], 0
    for line in lines:
        run = run + 1 if out and line == out[-1] else 0
        if runs or run < 3 or len(line) > 40:
            out.append(line)
    return out


def main_text(root: Node) -> str:
    """The main part with the most words, else the body."""
    parts = [n for n in root.walk() if n.tag in ("article", "main") or n.get("role") == "main" or "entry-content" in n.classes() or "markdown-body" in n.classes() or n.get("id") == "content"]
    texts = ["\n".join(block_text(n)) for n in parts]
    best = max(texts, key=words, default="")
    return best if words(best) > 20 else "\n".join(block_text(root.first("body") or root))


def to_markdown(root: Node) -> str:
    """Headings, lists, links, code and paragraphs of the main part as markdown."""
    out: list[str] = []

    def inline(n: Node | str) -> str:
        if isinstance(n, str):
            return n
        if n.tag in SILENT:
            return ""
        text = "".join(inline(c) for c in n.children)
        if n.tag == "a" and n.get("href") and text.strip():
            return f"[{text.strip()}]({n.get('href')})"
        if n.tag in ("b", "strong") and text.strip():
            return f"**{text.strip()}**"
        if n.tag == "code" and text.strip():
            return f"`{text.strip()}`"
        return "\n" if n.tag == "br" else text

    def visit(n: Node) -> None:
        if n.tag in SILENT:
            return
        if re.fullmatch(r"h[1-6]", n.tag):
            out.append(f"{'#' * int(n.tag[1])} {n.text()}")
        elif n.tag == "pre":
            out.append(f"```{_code_language(n.first('code') or n, n) or ''}\n" + n.raw_text().strip("\n") + "\n```")
        elif n.tag == "li":
            out.append("- " + " ".join("".join(inline(c) for c in n.children).split()))
        elif n.tag in ("p", "td", "blockquote", "dd", "dt"):
            out.append(" ".join("".join(inline(c) for c in n.children).split(" ")).strip())
        else:
            for c in n.children:
                if isinstance(c, Node):
                    visit(c)
                elif c.strip():
                    out.append(" ".join(c.split()))

    visit(root.first("article", "main") or root.first("body") or root)
    return normalized_markdown("\n\n".join(x for x in out if x))


ESCAPES = re.compile(r"\\([#_*\[\]()`>+.!-])")


def normalized_markdown(text: str) -> str:
    """Without needless escapes outside of code fences, without repeated navigation links, two line ends at most."""
    lines, fenced = [], False
    for line in text.split("\n"):
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        lines.append(line if fenced else ESCAPES.sub(r"\1", line))
    kept, seen = [], set()
    for line in lines:
        s = line.strip()
        if m := re.fullmatch(r"(?:[-*]\s+)?\[[^\]]*\]\(([^)\s]+)\)", s):
            if m[1] in seen:
                continue
            seen.add(m[1])
        elif s and not s.startswith("#"):
            seen.clear()
        kept.append(line)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip()


def collapsed_runs(text: str, n: int, most: int) -> str:
    """Sequences of n words repeated more than `most` times in a row, once; a long enough text becomes one line."""
    t = text.split()
    if n <= 0 or len(t) < n * (most + 1):
        return text
    same = bytes(a == b for a, b in zip(t, t[n:], strict=False))  # a word and the one n further on
    if same.find(b"\1" * (n * most)) < 0:
        return " ".join(t)
    out, i = [], 0
    while i < len(t):
        run = 1
        while t[i : i + n] == t[i + run * n : i + (run + 1) * n] and i + (run + 1) * n <= len(t):
            run += 1
        if run > most:
            out += t[i : i + n]
            i += run * n
        else:
            out.append(t[i])
            i += 1
    return " ".join(out)


def without_noise(text: str) -> str:
    """Repeated short word runs and repeated neighbouring lines once."""
    s = collapsed_runs(collapsed_runs(text.replace("==========", "\n"), 4, 5), 3, 6)
    out: list[str] = []
    for line in (x.strip() for x in s.splitlines()):
        if line and (not out or out[-1] != line):
            out.append(line)
    return "\n".join(out)


def is_json_noise(line: str) -> bool:
    n = len(line.encode())
    if n < 20:
        return False
    return line[0] in "{[" and n > 40 or sum(map(line.count, '{}[]":,')) / n >= 0.55


GARBAGE = re.compile("|".join(tables.GARBAGE_LINES), re.IGNORECASE)


def post_cleaned(text: str, line_aware: bool = False) -> str:
    """Without garbage, JSON and repeated lines.  Unless line_aware, the text is one line first, as clean_text makes it."""
    lines = text.split("\n") if line_aware else [text]
    kept: list[str] = []
    for line in (" ".join(x.split()) for x in lines):
        if len(line.encode()) >= 2 and not GARBAGE.search(line) and not is_json_noise(line) and (not kept or kept[-1] != line):
            kept.append(line)
    return re.sub(r"\n{3,}", "\n\n", without_noise("\n".join(kept)))


def with_image_context(text: str, found: list[dict], page_title: str, most: int = 3) -> str:
    hints = [f"![{i['alt'] or i['title'] or page_title}]({i['src']})" for i in found[:most]]
    return f"{text}\n\n### Image Context\n\n" + "\n".join(hints) if hints else text


def contextual_code(markdown: str, blocks: list[dict]) -> list[dict]:
    """Code fences with the end of the prose before them, then other blocks; each code once."""
    out: dict[str, dict] = {}
    parts = re.split(r"(?ms)^```(\w*)[^\n]*\n(.*?)^```[^\n]*$", markdown)
    for i in range(1, len(parts), 3):
        before = parts[i - 1].strip()
        last = before.rpartition(". ")[2]
        context = last if words(last) >= 3 else before[-180:]
        code = parts[i + 1].rstrip("\n")
        if code.strip():
            out.setdefault(code, {"language": parts[i] or None, "code": code, "context": " ".join(context.split())})
    for b in blocks:
        out.setdefault(b["code"], {"language": b["language"], "code": b["code"], "context": ""})
    return list(out.values())
