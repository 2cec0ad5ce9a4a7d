"""Structured fields from page text, by pattern, keyword and schema."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import tables
from .text import or_null, page_date


@dataclass(frozen=True)
class Field:
    """What to extract: name, description, expected type and whether it must be there."""

    name: str
    description: str = ""
    kind: str | None = None
    required: bool = False

    @property
    def wants_array(self) -> bool:
        d, n = self.description.lower(), self.name.lower()
        return (self.kind or "").lower() in ("array", "list") or len(n) > 2 and n.endswith("s") or any(w in d for w in ("list", "array", "items"))

    @property
    def is_exempt(self) -> bool:
        """A label that is chosen, not quoted: it need not stand in the source."""
        n, d = self.name.lower(), self.description.lower()
        return n == "page_type" or n.endswith("_type") or any(w in d for w in ("page type", "classification", "category"))


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def emails(text: Column) -> Column:
    return matches(text, tables.EMAIL)


def phones(text: Column) -> Column:
    return F.slice(F.filter(F.transform(matches(text, tables.PHONE), lambda p: F.trim(p)), lambda p: F.octet_length(p) >= 10), 1, 5)


def prices(text: Column) -> Column:
    return F.slice(matches(text, tables.PRICE), 1, 10)


def keyword_variants(keyword: str) -> list[str]:
    """Spellings of a field's name, sorted: as it is, with spaces, without a _name at the end, joined."""
    k = keyword.lower().strip()
    some = {k, k.replace("_", " "), k.replace("-", " "), k.replace("_", "")}
    some |= {v for v in (k.removesuffix("_name"), k.removesuffix("_name").replace("_", " ")) if v}
    return sorted(v for v in some if v)


def after_keyword(text: Column, keyword: str, length: int = 500) -> Column:
    """The characters after the first of the keyword's spellings that occurs, or null."""
    low = F.lower(text)
    at = F.lit(None).cast("int")
    for v in reversed(keyword_variants(keyword)):
        p = F.instr(low, v)
        at = F.when(p > 0, p + len(v)).otherwise(at)
    return F.when(at.isNotNull(), F.substr(text, at, F.lit(length)))


def price_near(text: Column, keyword: str) -> Column:
    first = lambda t: or_null(F.regexp_extract(t, tables.PRICE, 0))
    return F.coalesce(first(after_keyword(text, keyword)), first(text))


def number_near(text: Column, keyword: str) -> Column:
    return F.replace(or_null(F.regexp_extract(after_keyword(text, keyword), tables.NUMBER, 0)), F.lit(","), F.lit("")).try_cast("double")


def text_near(text: Column, keyword: str) -> Column:
    line = F.trim(F.regexp_replace(F.regexp_extract(after_keyword(text, keyword), "^[^\\n]*", 0), "^[\\s:]+", ""))
    return F.when(F.octet_length(line) > 2, line)


def list_near(text: Column, keyword: str) -> Column:
    """Up to ten bullets after the keyword."""
    bullet = "^\\s*(?:[-•*]|\\d\\.)\\s+"
    lines = F.filter(F.split(after_keyword(text, keyword, 2000), "\\n"), lambda x: x.rlike(bullet))
    return F.slice(F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, bullet, ""))), lambda x: x != ""), 1, 10)


def main_topics(headings: Column) -> Column:
    """Different second- and third-level headings, eight at most; headings is array of struct(level, text)."""
    some = F.filter(headings, lambda h: h["level"].isin("h2", "h3") & (F.trim(h["text"]) != ""))
    return F.slice(F.array_distinct(F.transform(some, lambda h: F.trim(h["text"]))), 1, 8)


def crate_name(title: Column, content: Column) -> Column:
    pattern = "(?i)\\bcrate\\s+`?([A-Za-z0-9_-]+)"
    return F.coalesce(or_null(F.regexp_extract(title, pattern, 1)), or_null(F.regexp_extract(content, pattern, 1)))


def rustdoc_symbols(markdown: Column, kind: str) -> Column:
    """Names of documented items of a kind (struct, trait, enum, fn, macro, type, constant) that a page links to."""
    names = F.regexp_extract_all(markdown, F.lit(f"\\((?:[^()\\s]*/)?{kind}\\.([A-Za-z0-9_]+)\\.html[^()]*\\)"), F.lit(1))
    return F.slice(F.array_distinct(names), 1, 200)


def rustdoc_modules(markdown: Column) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(markdown, F.lit("\\(([A-Za-z0-9_]+)/index\\.html[^()]*\\)"), F.lit(1))), 1, 200)


# Words of a field that ask for documented items.
RUSTDOC_KINDS = {"struct": "struct", "trait": "trait", "enum": "enum", "function": "fn", "macro": "macro", "type alias": "type", "constant": "constant"}


def rustdoc_kind(field: Field) -> str | None:
    name = f"{field.name} {field.description}".lower()
    return next((kind for word, kind in RUSTDOC_KINDS.items() if word in name), "mod" if "module" in name else None)


# -- schemas from text, at planning time


def field_name(raw: str) -> str | None:
    name = re.sub(r"[^a-z0-9]+", "_", raw.strip().lower().encode("ascii", "ignore").decode()).strip("_")
    return name or None


def split_items(segment: str) -> list[str]:
    """Items of an enumeration, cut at commas and at and/or outside of brackets."""
    out, depth, item = [], 0, ""
    for part in re.split(r"([,()\[\]{}]|\s+(?:and|or)\s+)", segment):
        if part in "([{" and part:
            depth += 1
        elif part in ")]}" and part:
            depth -= 1
        if depth <= 0 and part and (part == "," or part.strip() in ("and", "or")):
            out.append(item)
            item = ""
        else:
            item += part
    return [re.sub(r"^(?:and|or)\s+", "", x.strip()) for x in [*out, item] if x.strip()]


def item_field(raw: str) -> Field | None:
    head, _, note = raw.partition("(")
    name, note = field_name(head), note.rstrip(") ").strip()
    if not name:
        return None
    said = f"{note} {head}".lower()
    kinds = {"array": ("array", "list"), "number": ("number", "integer", "float", "count"), "boolean": ("boolean", "true/false"), "object": ("object", "map")}
    kind = next((k for k, words in kinds.items() if any(w in said for w in words)), None)
    return Field(name, note, kind, "required" in said)


def schema_of(value: object) -> list[Field] | None:
    """Fields of a schema given as JSON: a list of names or objects, {fields: list}, or a map of names to types."""
    if isinstance(value, dict) and isinstance(value.get("fields"), list):
        value = value["fields"]
    if isinstance(value, list):
        out = []
        for x in value:
            if isinstance(x, str) and field_name(x):
                out.append(Field(x))
            elif isinstance(x, dict) and isinstance(x.get("name"), str):
                out.append(Field(x["name"], str(x.get("description", "")), x.get("type") or x.get("field_type"), bool(x.get("required"))))
        return out or None
    if isinstance(value, dict):
        return [Field(k, v if isinstance(v, str) else "", v if isinstance(v, str) and v in ("string", "number", "boolean", "array", "object") else None) for k, v in value.items()] or None
    return None


def schema_from_prompt(prompt: str) -> list[Field] | None:
    """Fields that a request names: as JSON, after "fields:", in braces, or after extract/return/get."""
    for block in re.findall(r"[\[{].*[\]}]", prompt, re.DOTALL):
        try:
            if fields := schema_of(json.loads(block)):
                return fields
        except ValueError:
            pass
    if names := re.findall(r'"?name"?\s*:\s*["\']([\w -]+)["\']', prompt):
        return [Field(n) for n in dict.fromkeys(names)]
    for pattern in (r"\{([^{}]+)\}", r"(?i)\bfields?\s*:\s*([^.\n]+)", r"(?i)\b(?:extract|return|get)\s+(?:the\s+)?(?:following\s*:?\s*)?([^.\n]+)"):
        if m := re.search(pattern, prompt):
            fields = [f for x in split_items(m[1]) if (f := item_field(x))]
            if fields:
                return fields
    return None


def value_of(field: Field, page: dict[str, Column]) -> Column:
    """The value of one field as array<string>; a scalar has one element, an absent value none.

    page: columns url, title, description, content, headings, page_type.
    """
    n, d = field.name.lower(), field.description.lower()
    one = lambda c: F.filter(F.array(c.cast("string")), lambda x: x.isNotNull() & (F.trim(x) != ""))
    content = page["content"]
    kind = rustdoc_kind(field)
    if n in ("title", "page_title", "name"):
        return one(page["title"])
    if "summary" in n or "description" in n:
        return one(F.coalesce(or_null(page["description"]), F.substring(content, 1, 500)))
    if "page_type" in n or "page type" in d:
        return one(page["page_type"])
    if "topic" in n:
        return main_topics(page["headings"])
    if kind:
        return rustdoc_modules(content) if kind == "mod" else rustdoc_symbols(content, kind)
    exact = {"url": one(page["url"]), "email": emails(content), "emails": emails(content), "phone": phones(content), "phones": phones(content), "price": one(price_near(content, "price")), "prices": prices(content), "date": one(page_date(content)), "published_at": one(page_date(content)), "crate_name": one(crate_name(page["title"], content))}
    if n in exact:
        return exact[n]
    if field.wants_array:
        return F.coalesce(list_near(content, n), F.array().cast("array<string>"))
    if "price" in n or "cost" in n:
        return one(price_near(content, n))
    if (field.kind or "") in ("number", "integer") or "number" in d or "count" in n:
        return one(number_near(content, n))
    return one(text_near(content, n))


def type_name(values: Column, field: Field) -> Column:
    """Whether the value is of the expected type."""
    if field.kind == "number":
        return F.get(values, F.lit(0)).try_cast("double").isNotNull()
    if field.kind == "boolean":
        return F.lower(F.get(values, F.lit(0))).isin("true", "false")
    return F.size(values) > 0
