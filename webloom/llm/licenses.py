"""Fuzzy search for short licence notices.

Texts become their words (runs of ASCII letters and digits and of any other
characters above ASCII, A-Z lower-cased) with one space between.  A notice that
occurs with at most k errors, cut into k + 1 pieces, has one piece intact: an
automaton finds the pieces, and around each the regex library looks for the
whole notice with bounded errors and improves the fit.

Exact phrases are found as well, at every place where their words follow each
other.  Null texts are empty ones; an empty text has no words and no labels;
rows that repeat are rows each; texts of any length are searched whole; columns
beside row and text are left out, whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Phrases searched for exactly.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
#: Notices searched for with errors.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache",
    "licensed under the gnu general public license": "gpl",
    "under the terms of the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute": "isc",
    "subject to the terms of the mozilla public license": "mpl",
    "free and unencumbered software released into the public domain": "unlicense",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution": "cc-by",
    "all rights reserved": "all-rights-reserved",
}
#: An error for so many characters, from one to MOST_ERRORS.
PER_ERROR, MOST_ERRORS = 12, 3
#: Bytes that are no part of a word become spaces, A-Z small letters.
_WORDS = bytes(c if c >= 128 or chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

_searcher: list = []


class Searcher:
    def __init__(self):
        import ahocorasick
        import regex

        self.seeds = ahocorasick.Automaton()
        self.notices, places = [], {}
        for notice, label in NOTICES.items():
            k = min(MOST_ERRORS, max(1, len(notice) // PER_ERROR))
            size = len(notice) // (k + 1)
            for i in range(k + 1):
                seed = notice[i * size : (i + 1) * size if i < k else len(notice)]
                places.setdefault(seed, []).append((len(self.notices), i * size))
            self.notices.append((len(notice), k, label, regex.compile(f"(?e)(?:{regex.escape(notice)}){{e<={k}}}")))
        for seed, at in places.items():
            self.seeds.add_word(seed, (len(seed), at))
        self.seeds.make_automaton()
        self.phrases = [(f" {p} ", len(p.split()), label) for p, label in PHRASES.items()]

    def fuzzy(self, joined: str) -> list[tuple[int, int, str, float]]:
        """(start, end, label, similarity) of the notices in joined words, in characters; the best of overlapping ones."""
        done, found = set(), {}
        for end, (n, places) in self.seeds.iter(joined):
            for which, offset in places:
                size, k, label, pattern = self.notices[which]
                start = end + 1 - n - offset
                if (which, start) in done:
                    continue
                done.add((which, start))
                low = max(0, start - k)
                if m := pattern.search(joined, low, min(len(joined), start + size + k)):
                    found[which, m.start()] = (m.start(), m.end(), label, 1 - sum(m.fuzzy_counts) / size)
        best: dict[int, tuple] = {}
        out = []
        for (which, _), hit in sorted(found.items()):
            last = best.get(which)
            if last and hit[0] < last[1]:
                if hit[3] <= last[3]:
                    continue
                out.remove(last)
            best[which] = hit
            out.append(hit)
        return sorted(out)

    def scan(self, text: str) -> tuple:
        words = text.encode("utf-8", "replace").translate(_WORDS).split()
        joined = b" ".join(words).decode("utf-8", "replace")
        spaced = f" {joined} "
        n, first, last, base = 0, None, None, set()
        for phrase, size, label in self.phrases:
            at = spaced.find(phrase)
            if at < 0:
                continue
            base.add(label)
            low = spaced.count(" ", 0, at)
            while at >= 0:
                n, high = n + 1, at
                at = spaced.find(phrase, at + 1)
            high = spaced.count(" ", 0, high)
            first, last = min(low, low if first is None else first), max(high, high if last is None else last)
        spans = self.fuzzy(joined)
        score = 1.0 if base else max((s[3] for s in spans), default=0.0)
        return len(words), n, first, last, sorted(base), sorted(base | {s[2] for s in spans}), score, spans


def searcher() -> Searcher:
    if not _searcher:
        _searcher.append(Searcher())
    return _searcher[0]


SCANNED = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:long,end:long,label:string,similarity:double>>"


@common.tidy
def _scanned(batches):
    s = searcher()
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("similarity", pa.float64())]))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
    for batch in batches:
        for some in common.sized_batches(batch, "_text"):
            got = [s.scan(t) for t in some.column("_text").to_pylist()]
            rows = [(*g[:4], ",".join(g[4]), ",".join(g[5]), g[6], [dict(zip(("start", "end", "label", "similarity"), x, strict=True)) for x in g[7]]) for g in got]
            columns = [pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([some.column("row"), *columns], names=["row", *names])


def scan(docs: DataFrame) -> DataFrame:
    """docs(row, text), row anything, with the counts, places, labels and fuzzy spans found; one pass, no shuffle.

    Spans are in characters of the joined words.
    """
    rows = docs.select("row", F.coalesce("text", F.lit("")).alias("_text"))
    empty = rows.sparkSession.createDataFrame([], SCANNED).schema
    schema = rows.select("row").schema
    for field in empty.fields:
        schema = schema.add(field)
    return rows.mapInArrow(_scanned, schema)
