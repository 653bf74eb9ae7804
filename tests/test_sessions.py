"""Sessions as state: late and out-of-order rows, timers, time to live, restarts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loam.streaming import sessions

SCHEMA = "session_id string, ts timestamp, client string"
T0 = datetime(2024, 1, 1)


@pytest.fixture
def rocksdb(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    sessions.use_rocksdb(spark)
    yield spark
    if old:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    else:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, src, out, check, make, mode="append"):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(src))
    q = make(stream).writeStream.format("json").option("path", str(out)).option("checkpointLocation", str(check)).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def put(spark, src, name, rows):
    import json
    import os

    os.makedirs(src, exist_ok=True)
    path = f"{src}/{name}.json"
    with open(path, "w") as f:
        for k, at, client in rows:
            f.write(json.dumps({"session_id": k, "ts": None if at is None else at.isoformat(), "client": client}) + "\n")
    n = int(name)
    os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))


def test_sessions_merge_by_hand():
    assert sessions.merged([], [(10, "b"), (0, "a"), (30, None)], 19) == [(0, 10, 2, "a", "b"), (30, 30, 1, None, None)]
    assert sessions.merged([(0, 10, 2, "a", "b"), (30, 30, 1, "c", "c")], [(25, "x")], 20) == [(0, 30, 4, "a", "c")]
    assert sessions.merged([(0, 0, 1, "b", "b")], [(0, "a")], 20) == [(0, 0, 2, "a", "b")]
    assert sessions.merged([(0, 5, 1, "a", "a")], [], 5) == [(0, 5, 1, "a", "a")]


def test_stream_equals_batch_and_goes_on_after_a_restart(rocksdb, tmp_path):
    spark, r = rocksdb, random.Random(4)
    src, out, check = tmp_path / "src", tmp_path / "out", tmp_path / "check"
    # five batches; rows up to 50 minutes out of order, within the watermark of an hour
    batches = []
    for b in range(5):
        base = T0 + timedelta(hours=3 * b)
        rows = [(r.choice(["a", "b", "c"]), base + timedelta(minutes=r.randint(0, 150)), r.choice(["web", "app", None])) for _ in range(40)]
        rows.sort(key=lambda x: x[1])
        shift = [(k, t, c) for k, t, c in rows if r.random() < 0.3]
        batches.append((rows, shift))
    sent = []
    for n, (rows, moved) in enumerate(batches):
        now = [x for x in rows if x not in moved or n == 4]
        late = [(k, t, c) for k, t, c in moved if n < 4 and t >= max(x[1] for x in now) - timedelta(minutes=50)]
        now += [x for x in moved if x not in late and x not in now]
        r.shuffle(now)
        put(spark, src, str(2 * n), now)
        sent += now
        if late:
            put(spark, src, str(2 * n + 1), late)
            sent += late
        if n == 2:  # stopped here; the next run goes on from its checkpoint
            run(spark, src, out, check, lambda s: sessions.closed_sessions(s, 900, "1 hour"))
    put(spark, src, "20", [("end", T0 + timedelta(days=9), "web"), (None, T0 + timedelta(days=9), "web"), ("end", None, "web")])
    put(spark, src, "21", [("a", T0, "too late"), ("end", T0 + timedelta(days=19), "web")])
    run(spark, src, out, check, lambda s: sessions.closed_sessions(s, 900, "1 hour"))
    got = [tuple(x) for x in spark.read.schema(sessions.CLOSED).json(str(out)).where("session_key <> 'end'").collect()]
    frame = spark.createDataFrame(sent, SCHEMA)
    want = [tuple(x) for x in sessions.batch_sessions(frame, 900).select("session_key", "start", "last_seen", "events", "first_client", "last_client").collect()]
    key = lambda x: (x[0], x[1])
    assert len(got) > 10 and sorted(got, key=key) == sorted(want, key=key)
    assert not any(x[4] == "too late" for x in got)


def test_last_seen_and_its_time_to_live(rocksdb, tmp_path):
    import time

    spark, src, check, got = rocksdb, tmp_path / "src", tmp_path / "check", []
    hour = lambda h: T0 + timedelta(hours=h)
    put(spark, src, "0", [("a", hour(5), "web"), ("a", hour(3), "app"), ("b", hour(1), None)])
    stream = spark.readStream.schema(SCHEMA).json(str(src))
    q = sessions.last_seen(stream, 1).writeStream.foreachBatch(lambda df, n: got.extend(map(tuple, df.collect()))).option("checkpointLocation", str(check)).outputMode("update").trigger(processingTime="0 seconds").start()
    try:
        until = time.monotonic() + 60
        while len(got) < 2 and time.monotonic() < until:
            time.sleep(0.2)
        time.sleep(2)  # longer than the time to live: the key begins anew
        put(spark, src, "1", [("a", hour(4), "x"), ("a", hour(9), "x")])
        while len(got) < 3 and time.monotonic() < until:
            time.sleep(0.2)
    finally:
        q.stop()
    assert sorted(got[:2]) == [("a", hour(3), hour(5), 2, "app"), ("b", hour(1), hour(1), 1, None)]
    assert got[2:] == [("a", hour(4), hour(9), 2, "x")]


def test_without_time_to_live_a_key_is_kept(rocksdb, tmp_path):
    spark, src, check, got = rocksdb, tmp_path / "src", tmp_path / "check", []
    hour = lambda h: T0 + timedelta(hours=h)
    for n, rows in enumerate([[("a", hour(5), "web")], [("a", hour(2), "app")], [("a", hour(9), None)]]):
        put(spark, src, str(n), rows)
        stream = spark.readStream.schema(SCHEMA).json(str(src))
        sessions.last_seen(stream).writeStream.foreachBatch(lambda df, n: got.extend(map(tuple, df.collect()))).option("checkpointLocation", str(check)).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    assert got[-1] == ("a", hour(2), hour(9), 3, "app")


def test_batch_sessions_of_a_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert sessions.batch_sessions(none).count() == 0
    rows = spark.createDataFrame([("a", T0, "x"), ("a", T0 + timedelta(minutes=29), None), ("a", T0 + timedelta(minutes=60), "y"), (None, T0, "z")], SCHEMA)
    assert [(r.events, r.first_client) for r in sessions.batch_sessions(rows).orderBy("start").collect()] == [(2, "x"), (1, "y")]
    assert rows.where(F.col("ts").isNull()).count() == 0
