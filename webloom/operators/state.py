"""Keyed state folded from ordered events: engines, hosts, proxies, sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import tables
from ..functions import quality as Q
from ..functions.text import first_match

HEALTH = "engine string, blocked_streak long, timeout_streak long, failure_streak long, cooldown_until timestamp, last_issue string"


def blocked_base(engine: Column) -> Column:
    return first_match([(engine == e, s) for e, s in tables.COOLDOWN_BLOCKED.items()], tables.COOLDOWN_BLOCKED_OTHER)


def engine_health(runs: DataFrame) -> DataFrame:
    """State of each engine after its runs(engine, ts, id, status, reason): streaks, cooldown, last issue.

    No engine's runs are gathered.  A success resets all, so only runs after the
    last one count; a block resets the other two streaks, a timeout the
    failures: each streak is a count of runs since the last that reset it.
    """
    r = runs.select("engine", F.struct("ts", "id").alias("at"), "status", "reason")
    blocked, timeout = F.col("status").isin("blocked", "recovered"), F.col("status") == "timeout"
    success, failed = F.col("status") == "success", F.col("status") == "failed"
    last = r.groupBy("engine").agg(
        F.max(F.when(success, F.col("at"))).alias("ok_at"),
        F.max(F.when(success | blocked, F.col("at"))).alias("block_at"),
        F.max(F.when(success | blocked | timeout, F.col("at"))).alias("time_at"),
        F.max(F.struct("at", "status", "reason")).alias("last"),
    )
    after = lambda c: c.isNull() | (F.col("at") > c)
    j = r.join(last, "engine")  # broadcast or split at a hot engine as their sizes turn out
    s = j.groupBy("engine").agg(
        F.count_if(blocked & after(F.col("ok_at"))).alias("blocked_streak"),
        F.count_if(timeout & after(F.col("block_at"))).alias("timeout_streak"),
        F.count_if(failed & after(F.col("time_at"))).alias("failure_streak"),
        F.max("last").alias("last"),
    )
    status = F.col("last.status")
    base = F.when(status.isin("blocked", "recovered"), blocked_base(F.col("engine"))).when(status == "timeout", tables.COOLDOWN_TIMEOUT).otherwise(tables.COOLDOWN_FAILED)
    streak = F.when(status.isin("blocked", "recovered"), F.col("blocked_streak")).when(status == "timeout", F.col("timeout_streak")).otherwise(F.col("failure_streak"))
    cap = first_match([(status == k, v) for k, v in tables.COOLDOWN_CAPS.items()], 0)
    rest = F.when(status != "success", Q.backoff_seconds(base, streak, cap))
    kind = F.when(status.isin("blocked", "recovered"), "blocked").otherwise(status)
    issue = F.when(status == "timeout", "timeout").when(status != "success", F.concat(kind, F.lit(":"), F.coalesce("last.reason", F.lit(""))))
    return s.select("engine", "blocked_streak", "timeout_streak", "failure_streak", rest.alias("cooldown_seconds"), F.timestamp_seconds(F.unix_timestamp("last.at.ts") + rest).alias("cooldown_until"), issue.alias("last_issue"))


def proxy_state(outcomes: DataFrame, max_failures: int = 3) -> DataFrame:
    """State of each proxy after its outcomes(url, ts, id, success, latency_ms): latency, failures, whether it is on.

    The latency is a running mean in whole numbers, so the outcomes of one proxy
    are folded in order; they come as sorted Arrow batches, never as one list.
    """
    schema = "url string, latency_ms long, failure_count long, enabled boolean, last_success timestamp"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for b in batches:
            out = []
            for url, ts, ok, ms in zip(b["url"], b["ts"], b["success"], b["latency_ms"], strict=True):
                if state is None or url != at:
                    if state is not None:
                        out.append((at, *state))
                    at, state = url, [0, 0, True, None]
                if ok:
                    state[1], state[3] = 0, ts
                    if ms is not None and ms == ms:
                        state[0] = int(ms) if state[0] == 0 else (state[0] * 7 + int(ms)) // 8
                else:
                    state[1] += 1
                    state[2] = state[2] and state[1] < max_failures
            yield pd.DataFrame(out, columns=["url", "latency_ms", "failure_count", "enabled", "last_success"]).astype({"last_success": "datetime64[ns]"})
        if state is not None:
            yield pd.DataFrame([(at, *state)], columns=["url", "latency_ms", "failure_count", "enabled", "last_success"]).astype({"last_success": "datetime64[ns]"})

    rows = outcomes.select("url", "ts", "id", "success", "latency_ms").repartition("url").sortWithinPartitions("url", "ts", "id")
    return rows.mapInPandas(fold, schema)


def best_proxy(proxies: DataFrame, as_of: Column, cooldown: int = 300) -> DataFrame:
    """The best of proxies(url, priority, latency_ms, failure_count, enabled, last_failure): priority first, then speed and reliability."""
    rested = F.col("last_failure").isNull() | (F.unix_timestamp(as_of) - F.unix_timestamp("last_failure") >= cooldown)
    score = F.col("priority") * 1000 - F.col("latency_ms") - F.col("failure_count") * 500
    return proxies.where(F.col("enabled") & rested).withColumn("score", score).orderBy(F.desc("score"), F.desc("url")).limit(1)


def proxy_status(proxies: DataFrame) -> DataFrame:
    score = F.col("priority") * 1000 - F.col("latency_ms") - F.col("failure_count") * 500
    return proxies.agg(F.count("*").alias("total"), F.count_if("enabled").alias("enabled"), F.max_by(F.when(F.col("enabled"), F.col("url")), F.when(F.col("enabled"), F.struct(score.alias("s"), "url"))).alias("best"))


def reloaded(new: DataFrame, old: DataFrame) -> DataFrame:
    """new(url, scheme, priority) with what is known of them from old(url, latency_ms, failure_count, enabled); `is_new` for the others."""
    o = old.select("url", "latency_ms", "failure_count", "enabled", F.lit(True).alias("known"))
    return new.join(o, "url", "left").select("url", "scheme", "priority", F.coalesce("latency_ms", F.lit(0)).alias("latency_ms"), F.coalesce("failure_count", F.lit(0)).alias("failure_count"), F.coalesce("enabled", F.lit(True)).alias("enabled"), F.col("known").isNull().alias("is_new"))


def chosen_engines(engines: DataFrame, cursor: int, as_of: Column, budget: int = 3) -> DataFrame:
    """The next engines(idx, engine, cooldown_until) in turn that do not rest; if all do, the one that is ready first."""
    ready = F.coalesce(F.col("cooldown_until") <= as_of, F.lit(True))
    every = Window.partitionBy()
    e = engines.select("*", ready.alias("ready"), F.count("*").over(every).alias("n"), F.max(ready).over(every).alias("any"))
    e = e.withColumn("turn", F.pmod(F.col("idx") - cursor, F.col("n")))
    some = e.where(F.col("ready") | ~F.col("any"))
    place = F.row_number().over(Window.orderBy(F.when(F.col("any"), F.col("turn")), "cooldown_until", "turn"))
    return some.withColumn("place", place).where(F.col("place") <= F.when(F.col("any"), budget).otherwise(1)).select("place", "engine")


def rescue_engine(engines: DataFrame, attempted: DataFrame, as_of: Column) -> DataFrame:
    """One engine that was not tried: a ready one, else the one that is ready first."""
    rest = engines.join(attempted.select("engine"), "engine", "left_anti")
    ready = F.coalesce(F.col("cooldown_until") <= as_of, F.lit(True))
    return rest.orderBy(F.desc(ready), F.when(~ready, F.col("cooldown_until")), "idx").limit(1).select("engine")


def host_guard(events: DataFrame, base: int = 5, cap: int = 120) -> DataFrame:
    """events(bucket, ts, id, ok) as bucket, streak, penalty_seconds: a failure adds one, a success takes one, never below none.

    The floor makes it a running minimum: the streak is the sum less the lowest
    sum so far, if that is below none.  Sums and minima are of one hour each,
    then put together, so no bucket's events come to one task.
    """
    e = events.select("bucket", F.floor(F.unix_timestamp("ts") / 3600).alias("hour"), "ts", "id", F.when(F.col("ok"), -1).otherwise(1).alias("v"))
    w = Window.partitionBy("bucket", "hour").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    hours = e.withColumn("sum", F.sum("v").over(w)).groupBy("bucket", "hour").agg(F.sum("v").alias("total"), F.min("sum").alias("low"))
    before = F.sum("total").over(Window.partitionBy("bucket").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")
    last = hours.withColumn("low", before + F.col("low")).groupBy("bucket").agg((F.sum("total") - F.least(F.min("low"), F.lit(0))).alias("streak"))
    return last.select("bucket", F.col("streak").cast("long").alias("streak"), F.when(F.col("streak") > 0, Q.backoff_seconds(F.lit(base), F.col("streak"), F.lit(cap))).otherwise(0).alias("penalty_seconds"))


def alive(rows: DataFrame, ts: str, as_of: Column, seconds: int) -> DataFrame:
    """Rows younger than so many seconds: what a cache or an idle state keeps."""
    return rows.where(F.col(ts) >= F.timestamp_seconds(F.unix_timestamp(as_of) - seconds))


def pruned(rows: DataFrame, key: str, ts: str, as_of: Column, seconds: int, capacity: int) -> DataFrame:
    """What a cache of limited size keeps of rows: key and time of the last use of each, not too old, the latest `capacity`."""
    last = alive(rows, ts, as_of, seconds).groupBy(key).agg(F.max(ts).alias(ts))
    return last.orderBy(F.desc(ts), key).limit(capacity)


def session_expiry(cookies: Column, now: Column) -> Column:
    """The earliest expiry of cookies (array of struct(expires)); a day from now if none says, null without cookies."""
    first = F.array_min(F.filter(F.transform(cookies, lambda c: c["expires"].cast("double")), lambda e: e > 0))
    return F.coalesce(first, F.when(F.size(cookies) > 0, now.cast("double") + 86_400))


def session_valid(expiry: Column, now: Column) -> Column:
    return F.coalesce(now < expiry - 60, F.lit(True))


def session_of(urls: DataFrame, sessions: DataFrame) -> DataFrame:
    """urls(url) with the session (key, cookies) of their host, else of the domain above."""
    from ..functions import url as U

    u = urls.select("url", U.domain_key(F.col("url")).alias("own"), U.parent_key(U.host(F.col("url"))).alias("above"))
    s = sessions.select("key", "cookies")
    j = u.join(s.toDF("own", "own_cookies"), "own", "left").join(s.toDF("above", "above_cookies"), "above", "left")
    return j.select("url", F.coalesce("own_cookies", "above_cookies").alias("cookies"))
