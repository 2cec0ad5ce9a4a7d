"""Language identification in two steps: family first, then the language.

A text becomes hashed counts of its letter pairs and triples.  Linear support
vector machines, one for each pair of families, choose the family; others, one
for each pair of its languages, choose the language within it.  A pair's margin
becomes a probability, a class's score is the mean over its pairs, and the
score of a prediction the product of both steps.

The machines are fitted on the driver to a bounded sample of labelled rows
(`sample` rows, shared evenly among the `languages` most frequent languages,
those of smallest hash); predictions cover every row and the whole of its text.

Defined results: null texts and texts without a letter give `und` and score 0;
with no labelled rows at all every row does; of languages that score alike the
first by name wins.  Rows that repeat are rows each.  A null id counts as neither
held out nor learned from.  Texts of any length are read whole, in batches bounded
by bytes and rows.  Other columns of docs, whatever their names, are untouched.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Hashed features, as a power of two.
BITS = 12
#: Rows of the sample that one task reads.
SALTS = 16
#: Languages by family; any other language is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo is lb nb nl nn no sv",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "finnic": "et fi",
    "indic": "bn gu hi mr ne pa ur",
    "semitic": "am ar he mt",
    "turkic": "az kk ky tr uz",
    "dravidian": "kn ml ta te",
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
#: Bytes that are ASCII but no letters count as spaces.
_CLEAN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def features(texts: list[bytes]) -> np.ndarray:
    """A unit vector of square-rooted counts for each text."""
    joined = b"\0\0\0".join(texts) + b"\0\0\0"
    b = np.frombuffer(joined, np.uint8)
    ends = np.cumsum([len(t) + 3 for t in texts])
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(ends, prepend=0))[:-2] << BITS
    pair = b[:-2].astype(np.uint32) | b[1:-1].astype(np.uint32) << 8
    out = np.zeros(len(texts) << BITS)
    for code, sound in ((pair | np.uint32(0xFF0000), (b[:-2] > 0) & (b[1:-1] > 0)), (pair | b[2:].astype(np.uint32) << 16, (b[:-2] > 0) & (b[1:-1] > 0) & (b[2:] > 0))):
        at = (code * np.uint32(2654435761) >> np.uint32(32 - BITS)).astype(np.int64) + doc
        out += np.bincount(at[sound], minlength=len(out))
    x = np.sqrt(out.reshape(len(texts), -1)).astype(np.float32)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def cleaned(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(_CLEAN)


def svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 12) -> np.ndarray:
    """Weights of a linear machine (squared hinge loss; y is 1 or -1), by coordinate descent on the dual."""
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    norm, draw = (x * x).sum(1) + 1 / (2 * cost), np.random.default_rng(7)
    for _ in range(rounds):
        for i in draw.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1 + alpha[i] / (2 * cost)
            new = max(alpha[i] - g / norm[i], 0.0)
            w += (new - alpha[i]) * y[i] * x[i]
            alpha[i] = new
    return w


class Choice:
    """One-versus-one machines among classes."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        self.classes = sorted(set(labels))
        is_ = {c: np.array([v == c for v in labels]) for c in self.classes}
        self.pairs = list(itertools.combinations(range(len(self.classes)), 2))
        some = [(is_[self.classes[a]], is_[self.classes[b]]) for a, b in self.pairs]
        self.w = np.array([svm(x[a | b], np.where(a[a | b], 1.0, -1.0)) for a, b in some]).T

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.classes)))
        if not self.pairs:
            return out + 1
        p = 1 / (1 + np.exp(-np.clip(4 * (x @ self.w), -50, 50)))
        for k, (a, b) in enumerate(self.pairs):
            out[:, a] += p[:, k]
            out[:, b] += 1 - p[:, k]
        return out / (len(self.classes) - 1)


class Model:
    def __init__(self, x: np.ndarray, langs: list[str]):
        families = [_FAMILY.get(v.lower(), v) for v in langs]
        self.family = Choice(x, families)
        self.within = {}
        for f in self.family.classes:
            some = np.array([v == f for v in families])
            self.within[f] = Choice(x[some], [v for v, s in zip(langs, some, strict=True) if s])

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        of = self.family.scores(x)
        best = of.argmax(1)
        lang, score = np.empty(len(x), object), of.max(1)
        for k, f in enumerate(self.family.classes):
            at = np.flatnonzero(best == k)
            if len(at):
                inner = self.within[f].scores(x[at])
                lang[at] = np.array(self.within[f].classes, object)[inner.argmax(1)]
                score[at] *= inner.max(1)
        return lang, score


#: Texts whose features a task holds at once, and bytes of them.
TEXTS, BYTES = 256, 1 << 20


@common.tidy
def _sampled(batches):
    schema = pa.schema([("lang", pa.string()), ("x", pa.binary())])
    for batch in batches:
        for some in common.sized_batches(batch, "text", BYTES, TEXTS):
            x = features([cleaned(t) for t in some.column("text").to_pylist()]).astype(np.float16)
            yield pa.RecordBatch.from_arrays([some.column("lang"), pa.array([v.tobytes() for v in x], pa.binary())], schema=schema)


def fit(docs: DataFrame, learn: Column, sample: int = 2048, languages: int = 128) -> Model | None:
    """Fits to at most about `sample` of the rows of docs(doc_id, text, lang) that `learn` picks; None where there are none.

    The `languages` values of lang with the most rows are learned, ties by
    name, so that labels full of errors make neither rows nor machines without
    bound; rows of the others are not learned from.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & F.coalesce(F.col("text"), F.lit("")).rlike("\\p{L}"))
    known = [r["lang"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()]
    each = max(1, sample // max(1, len(known)) // SALTS)
    h = F.xxhash64("doc_id", "text")
    rank = F.row_number().over(Window.partitionBy("lang", "salt").orderBy("h", "doc_id"))
    picked = rows.where(F.col("lang").isin(known)).select("doc_id", "lang", "text", h.alias("h"), F.pmod(F.shiftright(h, 20), F.lit(SALTS)).alias("salt")).withColumn("rank", rank).where(F.col("rank") <= each)
    got = picked.select("lang", "text").mapInArrow(_sampled, "lang string, x binary").toArrow()
    if not got.num_rows:
        return None
    order = sorted(range(got.num_rows), key=lambda i: (got["lang"][i].as_py(), got["x"][i].as_py()))
    x = np.array([np.frombuffer(got["x"][i].as_py(), np.float16) for i in order], np.float64)
    return Model(x, [got["lang"][i].as_py() for i in order])


def predicted(spark: SparkSession, text: Column, model: Model | None) -> Column:
    """struct(lang_pred, score) of a text: no shuffle, and only the text goes to Python.

    The model's size is fixed by the number of languages.  The column is
    computed when its frame is, so the session's Arrow batches are bounded here.
    """
    common.bound_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import regex

        letter, m = regex.compile(r"\p{L}"), sent.value

        def one(texts: pa.Array) -> pa.Array:
            lang, score = [], [np.zeros(0)]
            for some in common.sized_batches(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", BYTES, TEXTS):
                part = some.column("text").to_pylist()
                at = [i for i, t in enumerate(part) if m is not None and t is not None and letter.search(t)]
                names, p = ["und"] * len(part), np.zeros(len(part))
                if at:
                    found, p[at] = m.predict(features([cleaned(part[i]) for i in at]))
                    for i, v in zip(at, found, strict=True):
                        names[i] = v
                lang += names
                score.append(p)
            return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(np.concatenate(score))], names=["lang_pred", "score"])

        return common.tidy(lambda all_: map(one, all_))(batches)

    told.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(told, "lang_pred string, score double")(text)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs(row, text), row anything, as row, lang_pred, score."""
    told = docs.select("row", predicted(docs.sparkSession, F.col("text"), model).alias("told"))
    return told.select("row", "told.lang_pred", "told.score")
