"""Mixes sources to target weights by Efraimidis-Spirakis sampling.

Each document draws u in (0, 1) from a hash of itself and gets the exponential
key u ** (1 / w), w its quality weight.  Within a source documents stand by
falling key; the key kept is -log(u) / w, which rises as it falls and has no
bounds, so that small weights keep keys apart.  A source's token target is met
by complete epochs first; the rest is a prefix of the sorted documents whose
sizes sum up to it.

No document is moved for this: the logarithms of keys fall into buckets of
equal width, one small sum for each (source, bucket) finds the bucket in which
the budget ends, and only that bucket's documents, some thousandths of a source
at most, are sorted.  The cut is then one key for each source.

Defined results: null text has size 0; a null source is a source of its own,
ordered last; rows that repeat (same id and text) share one decision; of equal
keys all are taken or none; the document at the cut is taken if that brings the
sum nearer to the target; texts of any length count whole; without rows the mix
has none.  Other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Buckets of a doubling of the key.
BUCKETS = 1024
SEED = "mix-1"


def size_of(text: Column) -> Column:
    """Number of words, separated by white space of ASCII."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """Weight in [0.05, 1] by a rule: falls by 4 with the share of characters that are neither letters nor spaces."""
    n = F.length(text)
    other = F.length(F.regexp_replace(text, "[\\p{L} ]+", ""))
    return F.when(n > 0, F.greatest(1 - 4 * other / n, F.lit(0.05))).otherwise(F.lit(0.05))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with `weight`: the rule's, a tenth of it if labels(doc_id, quality) call the document bad, half of it if they are silent.

    Labels are broadcast if they take few bytes.  Of several labels the lowest counts.
    """
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("d")).agg(F.min("quality").alias("q"))
    rows = docs.select(F.struct(*[c for c in docs.columns if c != "weight"]).alias("row"))
    known = rows.join(common.near(common.stored(said, "labels", keep=True)), F.col("d") == F.col("row.doc_id"), "left")
    factor = F.when(F.col("q") > 0, 1.0).when(F.col("q") <= 0, 0.1).otherwise(0.5)
    return known.select("row", (quality(F.col("row.text")) * factor).alias("weight")).select("row.*", "weight")


def keyed(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """docs with `key`, low where the exponential key is high, and its `bucket`.

    weight: a positive number for each document, from any scorer; a null one is the least, without it the rule's.
    """
    text = F.coalesce("text", F.lit(""))
    w = quality(text) if weight is None else F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(1e-6))
    draw = F.substring(F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text))), 1, 12)
    u = (F.conv(draw, 16, 10).cast("double") + 0.5) / float(1 << 48)
    d = docs.withColumn("key", -F.log(u) / w)
    return d.withColumn("bucket", F.floor(F.log2("key") * BUCKETS).cast("int"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes(source, source_size) with `target`.

    Sources by code point, null last, take the weights in turn and share
    `share` of all sizes; a target above cap * source_size is cut to that and
    the excess goes to the others by weight, until none is above.  That is the
    level L at which the sum of min(weight * L, cap * size) is the total: with
    sources sorted by cap * size / weight, the largest of the levels at which
    the first k sources are at their caps.
    """
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    s = sizes.select("source", "source_size", w.alias("w"), (cap * F.col("source_size")).alias("most"))
    up = Window.orderBy(F.col("most") / F.col("w"), F.asc_nulls_last("source"))
    everything = Window.partitionBy()
    s = s.select("*", F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, 0)).alias("capped"), F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing)).alias("rest"), (share * F.sum("source_size").over(everything)).alias("total"))
    level = F.max((F.col("total") - (F.col("capped") - F.col("most"))) / F.col("rest")).over(everything)
    return s.select("source", "source_size", F.least("most", F.col("w") * level).alias("target"))


def _near(sources: DataFrame) -> DataFrame:
    """A table of a row for each source, kept, and broadcast if it takes few bytes: a large source then stays where its rows are."""
    return common.near(common.stored(sources, "sources", keep=True))


def plan(docs: DataFrame, **mix) -> DataFrame:
    """Per source: source_size, target, epochs, and where the fractional epoch ends (end_bucket, end_key).

    docs(source, size, key, bucket).
    """
    sums = docs.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    goal = targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")), **mix)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("epochs", epochs).withColumn("part", F.col("target") - F.col("epochs") * F.col("source_size"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
    at = sums.select("source", "bucket", "size", upto.alias("upto")).withColumnRenamed("source", "s")
    same = F.col("s").eqNullSafe(F.col("source"))
    end = at.join(goal, same).where(F.col("upto") > F.col("part")).groupBy("source").agg(F.min(F.struct("bucket", "upto", "size", "part")).alias("e"))
    end = _near(end.select(F.col("source").alias("s"), F.col("e.bucket").alias("b"), (F.col("e.upto") - F.col("e.size")).alias("before"), F.col("e.part").alias("part")))
    inside = docs.join(end, F.col("s").eqNullSafe(F.col("source")) & (F.col("b") == F.col("bucket")))
    each = inside.groupBy("source", "b", "before", "part", "key").agg(F.sum("size").alias("n"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("source").orderBy("key")) - F.col("n") / 2
    cut = each.withColumn("mid", upto).groupBy("source", "b").agg(F.max(F.when((F.col("mid") <= F.col("part")) & (F.col("part") > 0), F.col("key"))).alias("end_key"))
    cut = cut.select(F.col("source").alias("s"), F.col("b").alias("end_bucket"), F.coalesce("end_key", F.lit(-1.0)).alias("end_key"))
    return goal.join(cut, same, "left").select("source", "source_size", "target", "epochs", "part", "end_bucket", "end_key")


def copies(docs: DataFrame, goal: DataFrame) -> DataFrame:
    """docs(source, key, bucket, ...) with source_size, target and `copies`, how often the mix takes the document."""
    g = _near(goal.withColumnRenamed("source", "s"))
    inside = (F.col("bucket") < F.col("end_bucket")) | (F.col("bucket") == F.col("end_bucket")) & (F.col("key") <= F.col("end_key"))
    extra = F.when((F.col("part") > 0) & F.coalesce(inside, F.lit(False)), 1).otherwise(0)
    return docs.join(g, F.col("s").eqNullSafe(F.col("source"))).withColumn("copies", F.col("epochs") + extra).drop("s", "epochs", "part", "end_bucket", "end_key")


def measured(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """doc_id, source, size, key, bucket of docs, kept in the shared folder: texts are read once for them."""
    own = docs.select("doc_id", "source", "text", size_of(F.col("text")).alias("size"), *([] if weight is None else [weight.alias("weight")]))
    d = keyed(own, None if weight is None else F.col("weight"))
    return common.stored(d.select("doc_id", "source", "size", "key", "bucket"), "mix")


def mixed(docs: DataFrame, weight: Column | None = None, **mix) -> DataFrame:
    """The mix itself: docs' rows, each as often as it is taken."""
    goal = plan(measured(docs, weight), **mix)
    own = [] if weight is None else [weight.alias("weight")]
    packed = keyed(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", "text", *own), None if weight is None else F.col("weight"))
    taken = copies(packed, goal).where(F.col("copies") > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
