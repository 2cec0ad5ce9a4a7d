"""Keyed state of streams against folds in plain Python, over restarts, replays and timers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from webloom.operators import state as ST
from webloom.streaming import keyed

T0 = dt.datetime(2024, 1, 1)


def written(spark, path, part, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/in/part={part}")
    return spark.readStream.schema(schema).parquet(f"{path}/in/part=*")


RUN = "engine string, ts timestamp, id long, status string, reason string"


def test_health_equals_the_batch_fold(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice(["brave", "google", "x"]), T0 + dt.timedelta(minutes=i // 2), i, rng.choice(["success", "blocked", "recovered", "timeout", "failed", "failed"]), rng.choice([None, "r"])) for i in range(400)]
    for part, some in enumerate((rows[:150], rows[150:310], rows[310:])):
        shuffled = some[:]
        rng.shuffle(shuffled)
        got = keyed.run(written(spark, tmp_path, part, shuffled, RUN), "engine", keyed.EngineHealth(), str(tmp_path), "2 minutes")
    want = ST.engine_health(spark.createDataFrame(rows, RUN))
    cols = ["engine", "blocked_streak", "timeout_streak", "failure_streak", "cooldown_seconds", "last_issue"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


CALL = "bucket string, ts timestamp, id long, ok boolean"


def test_guard_equals_plain_python_and_forgets(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), T0 + dt.timedelta(seconds=20 * i), i, rng.random() < 0.45) for i in range(300)]
    want = {}
    for b, ts, _, ok in rows:
        streak, after = want.get(b, (0, 0))
        now = int((ts - keyed.EPOCH).total_seconds() * 1000)
        if ok:
            streak = max(0, streak - 1)
        else:
            streak += 1
            after = max(after, now) + 1000 * min(5 * 2 ** min(streak - 1, 4), 120)
        want[b] = streak, after
    for part, some in enumerate((rows[:120], rows[120:])):
        got = keyed.run(written(spark, tmp_path, part, some, CALL), "bucket", keyed.HostGuard(idle_seconds=3600), str(tmp_path), "1 minute")
    assert {r.bucket: (r.streak, r.next_ms) for r in got.collect()} == want
    # another bucket's call, hours later, moves the watermark: the idle ones are forgotten
    for part, ts in ((2, T0 + dt.timedelta(hours=9)), (3, T0 + dt.timedelta(hours=10))):
        got = keyed.run(written(spark, tmp_path, part, [("c", ts, 900 + part, False)], CALL), "bucket", keyed.HostGuard(idle_seconds=3600), str(tmp_path), "1 minute")
    assert {r.bucket: r.streak for r in got.collect()} == {"a": 0, "b": 0, "c": 1}


ASK = "key string, ts timestamp, id long"


def test_cache_entries_expire_by_timer(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    first = [("k", at(0), 1), ("k", at(9), 2), ("k", at(10), 3), ("j", at(1), 4)]
    got = keyed.run(written(spark, tmp_path, 0, first, ASK), "key", keyed.Cache(600), str(tmp_path))
    assert {r.key: (r.hits, r.misses, r.alive) for r in got.collect()} == {"k": (1, 2, True), "j": (0, 1, True)}
    for part, m in ((1, 60), (2, 61)):
        got = keyed.run(written(spark, tmp_path, part, [("z", at(m), 10 + part)], ASK), "key", keyed.Cache(600), str(tmp_path))
    assert {r.key: (r.hits, r.misses, r.alive) for r in got.collect()} == {"k": (1, 2, False), "j": (0, 1, False), "z": (1, 1, True)}


@pytest.mark.parametrize("again", [1, 2])
def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path, again):
    put = keyed.upserting(str(tmp_path), "key")
    one = spark.createDataFrame([("a", 1, 0, True, 5), ("b", 1, 0, True, 5)], keyed.Cache.OUT)
    two = spark.createDataFrame([("a", 2, 0, True, 9)], keyed.Cache.OUT)
    for _ in range(again):
        put(one, 0)
        put(two, 1)
    got = keyed.current(spark, str(tmp_path), "key", keyed.Cache.OUT)
    assert {r.key: r.hits for r in got.collect()} == {"a": 2, "b": 1}
