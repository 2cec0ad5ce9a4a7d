"""Shared storage, sizing and text expressions."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import gc
import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, named by spark.checkpoint.dir.

    Only a local session that names none (tests) gets a temporary one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="webloom-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/webloom/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int, size: int = 8 << 20) -> Iterator[None]:
    """Within, Arrow batches that go to Python hold so many rows and bytes at most: rows of long texts or sets are large."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def bound_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """From now on Arrow batches of the session hold at most so many bytes, or fewer if it says so already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, str(min(size, int(spark.conf.get(key).rstrip("b")))))


#: Paths of the tables of each open scratch(), innermost last.
_scopes: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scopes", default=())


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Within, tables that stored() writes last until the end, but for those to keep.

    What is returned from it must read no others.  Then the driver lets go of
    plans, broadcasts and shuffles that nothing names any more.
    """
    outer = _scopes.get()
    mark = _scopes.set((*outer, []))
    try:
        yield
    finally:
        paths = _scopes.get()[-1]
        _scopes.reset(mark)
        _delete(spark, paths)
        relieve(spark)


def relieve(spark: SparkSession) -> None:
    """Lets the driver go of plans, broadcasts and shuffles that nothing names any more; executors then drop theirs."""
    gc.collect()
    spark._jvm.System.gc()


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, name: str, batch: int = 2000, keep: bool = False) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage.

    keep: the table outlives the scratch() that it is made in (one around that may end it).
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    scopes = _scopes.get()[: -1 if keep else None]
    if scopes:
        scopes[-1].append(path)
    with batches_of(spark, batch):
        df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def spent(*tables: DataFrame) -> None:
    """Deletes tables of stored() that nothing reads any more, ahead of their scratch()."""
    for t in tables:
        _delete(t.sparkSession, [t.stored_at])


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate; for a plain scan, the bytes of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts_for(df: DataFrame, target: int) -> int:
    """How many partitions of about `target` input bytes hold df; the session's number if its size is not known."""
    size = plan_bytes(df)
    if size >= 1 << 60:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(200_000, math.ceil(size / target)))


def let_go() -> None:
    """Gives back the memory that a Python worker has freed: workers stay when their tasks have ended."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


#: What a worker keeps between tasks (tokenizers, say), by the module that does.
_kept: dict[str, list[dict]] = {}


def keeps(module: str) -> dict:
    """A dictionary that lasts as long as a worker's tasks are of the module; tasks of another one forget it."""
    _kept.setdefault(module, []).append({})
    return _kept[module][-1]


def forget_others(module: str) -> None:
    others = [d for m, kept in _kept.items() if m != module for d in kept if d]
    for d in others:
        d.clear()
    if others:
        gc.collect()
        let_go()


def tidy(run):
    """A function of Arrow batches that gives memory back when it has read them all."""

    def outer(batches):
        forget_others(run.__module__)
        try:
            yield from run(batches)
        finally:
            let_go()

    return outer


def sized_batches(batch, column: str, limit: int = 4 << 20, most: int = 1 << 30):
    """Slices of an Arrow batch holding at most about `limit` bytes of one string or binary column, and `most` rows, each."""
    lengths = batch.column(column)
    size = at = 0
    for i, value in enumerate(lengths):
        n = value.as_buffer().size if value.is_valid else 0
        if size and size + n > limit or i - at >= most:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n
    if at < batch.num_rows:
        yield batch.slice(at)


#: Bytes of keys, with what a hash table adds to each, that a join may broadcast.
BROADCAST = 32 << 20


def near(df: DataFrame, most: int = BROADCAST) -> DataFrame:
    """df (stored), broadcast in joins if it takes at most `most` bytes; else joins shuffle."""
    size = F.lit(32 + 8 * len(df.columns))
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            size += 8 + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind.startswith("array"):
            size += 24 * F.greatest(F.size(name), F.lit(0)) + (F.octet_length(F.concat_ws("", name)) if kind == "array<string>" else 0)
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= most else df


def bits_for(n: int) -> int:
    """Bits, as a power of two, of a bit_table of n keys: few keys are taken for others up to some ten millions, none is larger than 32 MB."""
    return min(28, max(16, math.ceil(math.log2(16 * max(1, n)))))


def bit_table(keys: DataFrame, bits: int) -> np.ndarray:
    """A table of 2**bits bits: set at the top bits of each of keys(key), longs.  Its size does not depend on how many there are."""
    bit = F.shiftrightunsigned("key", 64 - bits)
    words = keys.select(bit.alias("bit")).groupBy(F.shiftright("bit", 5).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 32 as int)))").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 5), np.uint32)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return table.view(np.uint8)


def in_table(table: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Whether each of the unsigned keys may be in a bit_table."""
    at = (keys >> np.uint64(64 - bits)).astype(np.int64)
    return (table[at >> 3] >> (at & 7) & 1).astype(bool)
