"""Many words looked for at once: an automaton of all of them reads a text in one pass and reports every hit, overlapping ones too."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_automata: dict[tuple[str, ...], object] = {}


def _automaton(needles: tuple[str, ...]):
    """One for each set of needles, kept in the worker."""
    if needles not in _automata:
        import ahocorasick

        a = ahocorasick.Automaton()
        for i, w in enumerate(needles):
            a.add_word(w, i)
        a.make_automaton()
        _automata[needles] = a
    return _automata[needles]


def hits(text: Column, needles: list[str]) -> Column:
    """The needles that occur in a text, in the order of the list and once each; null has none.

    An empty needle is in no text.  Take the column before it is used more than
    once (`withColumn`): it is then computed once for each row.
    """
    known = tuple(dict.fromkeys(n for n in needles if n))

    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        a = _automaton(known) if known else None
        for texts in batches:
            out, ends = [], [0]
            for t in texts:
                some = {i for _, i in a.iter(t.as_py())} if a is not None and t.is_valid else ()
                out += sorted(some)
                ends.append(len(out))
            words = pa.array(known, pa.string()).take(pa.array(out, pa.int32()))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words)

    found.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(found, "array<string>")(text)


def has(found: Column, words: list[str]) -> Column:
    """Whether one of the words is among the hits."""
    return F.arrays_overlap(found, F.array(*[F.lit(w) for w in words]))
