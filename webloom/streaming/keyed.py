"""State of keys in a stream: engines' health, hosts' penalties, caches whose entries expire.

Each processor keeps one value for a key in Spark's state store and folds the
rows of a micro-batch into it in the order of their times; what a query holds
at its checkpoint is what the next run begins with.  The folds are those of
operators.state, which compute them over a whole table at once.

Timers of event time take idle state away.  A key's rows of one micro-batch are
sorted in the task that has the key: bound micro-batches by the source's
maxFilesPerTrigger or maxBytesPerTrigger.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from .. import tables

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = dt.datetime(1970, 1, 1)


def _sorted(rows: Iterator[pd.DataFrame], *order: str) -> Iterator[tuple]:
    """A key's rows of this micro-batch in order."""
    parts = [p for p in rows if len(p)]
    if parts:
        yield from pd.concat(parts).sort_values([*order]).itertuples(index=False)


def _millis(ts) -> int:
    return int(pd.Timestamp(ts).value // 1_000_000)


class EngineHealth(StatefulProcessor):
    """Streaks of an engine's runs(engine, ts, id, status, reason), and how long it rests.

    A success resets all; a block or a recovery the other two streaks, a timeout the failures.
    """

    STATE = "blocked long, timeout long, failed long, last_ms long, last_status string, last_reason string"
    OUT = "engine string, blocked_streak long, timeout_streak long, failure_streak long, cooldown_seconds long, last_ms long, last_issue string"

    def __init__(self, idle_seconds: int | None = None):
        self.idle = idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("health", self.STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        blocked, timeout, failed, last, status, reason = self.state.get() if self.state.exists() else (0, 0, 0, 0, None, None)
        for r in _sorted(rows, "ts", "id"):
            status, reason, last = r.status, r.reason if isinstance(r.reason, str) else None, _millis(r.ts)
            if status == "success":
                blocked = timeout = failed = 0
            elif status in ("blocked", "recovered"):
                blocked, timeout, failed = blocked + 1, 0, 0
            elif status == "timeout":
                timeout, failed = timeout + 1, 0
            elif status == "failed":
                failed += 1
        self.state.update((blocked, timeout, failed, last, status, reason))
        if self.idle is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(last + 1000 * self.idle)
        yield pd.DataFrame([self._told(key[0], blocked, timeout, failed, last, status, reason)], columns=[c.split()[0] for c in self.OUT.split(", ")])

    @staticmethod
    def _told(engine, blocked, timeout, failed, last, status, reason) -> tuple:
        if status in ("blocked", "recovered"):
            kind, base, streak = "blocked", tables.COOLDOWN_BLOCKED.get(engine, tables.COOLDOWN_BLOCKED_OTHER), blocked
        elif status == "timeout":
            kind, base, streak = "timeout", tables.COOLDOWN_TIMEOUT, timeout
        else:
            kind, base, streak = status, tables.COOLDOWN_FAILED, failed
        rest = None if status == "success" else min(base * 2 ** min(max(streak - 1, 0), 4), tables.COOLDOWN_CAPS.get(status, 0))
        issue = "timeout" if status == "timeout" else None if status == "success" else f"{kind}:{reason or ''}"
        return engine, blocked, timeout, failed, rest, last, issue

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame([], columns=[c.split()[0] for c in self.OUT.split(", ")])

    def close(self) -> None:
        pass


class HostGuard(StatefulProcessor):
    """Streak and next start of a bucket's calls(bucket, ts, id, ok): a failure adds one and rests it, a success takes one away.

    Rests add up: each begins where the last one ends, or now.  A bucket that
    has been idle for `idle_seconds` is forgotten.
    """

    STATE = "streak long, next_ms long, updated_ms long"
    OUT = "bucket string, streak long, next_ms long, updated_ms long"

    def __init__(self, base: int = 5, cap: int = 120, idle_seconds: int | None = None):
        self.base, self.cap, self.idle = base, cap, idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", self.STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        streak, after, updated = self.state.get() if self.state.exists() else (0, 0, 0)
        for r in _sorted(rows, "ts", "id"):
            now = _millis(r.ts)
            if self.idle is not None and updated and now >= updated + 1000 * self.idle:
                streak, after = 0, 0
            if r.ok:
                streak = max(0, streak - 1)
            else:
                streak += 1
                rest = min(self.base * 2 ** min(streak - 1, 4), self.cap)
                after = max(after, now) + 1000 * rest
            updated = now
        self.state.update((streak, after, updated))
        if self.idle is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(updated + 1000 * self.idle)
        yield pd.DataFrame([(key[0], streak, after, updated)], columns=["bucket", "streak", "next_ms", "updated_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        streak, after, updated = self.state.get()
        self.state.clear()
        yield pd.DataFrame([(key[0], 0, 0, updated)], columns=["bucket", "streak", "next_ms", "updated_ms"])

    def close(self) -> None:
        pass


class Cache(StatefulProcessor):
    """Hits and misses of a cache whose entries live for `seconds` after they were put in: asks(key, ts, id).

    The first ask misses and puts the entry in; asks before its end hit; its
    end takes it out (a timer does where no ask comes any more).
    """

    STATE = "until_ms long, hits long, misses long"
    OUT = "key string, hits long, misses long, alive boolean, until_ms long"

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("entry", self.STATE)

    def _row(self, key, hits, misses, alive, until) -> pd.DataFrame:
        return pd.DataFrame([(key[0], hits, misses, alive, until)], columns=["key", "hits", "misses", "alive", "until_ms"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        until, hits, misses = self.state.get() if self.state.exists() else (-1, 0, 0)
        for r in _sorted(rows, "ts", "id"):
            now = _millis(r.ts)
            if now < until:
                hits += 1
            else:
                misses, until = misses + 1, now + 1000 * self.seconds
        self.state.update((until, hits, misses))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(until)
        yield self._row(key, hits, misses, True, until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until, hits, misses = self.state.get()
        yield self._row(key, hits, misses, False, until)

    def close(self) -> None:
        pass


def folded(rows: DataFrame, key: str, processor: StatefulProcessor, late: str = "0 seconds") -> DataFrame:
    """The stream rows(key, ts, ...) folded by a processor: a row for each key that a micro-batch touches."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    marked = rows.withWatermark("ts", late)
    return marked.groupBy(key).transformWithStateInPandas(processor, StructType.fromDDL(processor.OUT), "Update", "EventTime")


def upserting(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """Keeps the last row of each key as a table of batches: each batch is a folder of its own, written whole, so a batch that comes again changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_nth", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def current(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """The rows that upserting() keeps: of each key the last batch's, and of that the last one."""
    names = [c.split()[0] for c in schema.split(", ")]
    rows = spark.read.schema(f"{schema}, _nth long, batch long").option("basePath", path).parquet(f"{path}/batch=*")
    last = rows.groupBy(F.col(key)).agg(F.max_by(F.struct(*names), F.struct("batch", "_nth")).alias("r"))
    return last.select("r.*")


def run(source: DataFrame, key: str, processor: StatefulProcessor, path: str, late: str = "0 seconds") -> DataFrame:
    """Folds what is there of a stream and stops; run again with the same path it goes on from its checkpoint."""
    q = folded(source, key, processor, late).writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").foreachBatch(upserting(f"{path}/state", key)).trigger(availableNow=True).start()
    q.awaitTermination()
    return current(source.sparkSession, f"{path}/state", key, processor.OUT)
