"""Sessions as state of a stream: per key the open ones, closed by timers.

A session is a run of events of a key with no more than ``gap`` seconds between
neighbours, as Spark's session windows have it. Rows may come late and out of order, up to the watermark: one that falls
between two open sessions joins them. When the watermark passes the end of a session
(last event and gap) a timer emits it and takes it out of the state, so state holds open
sessions alone. Rows behind the watermark are let go, rows without a key or a time too.

``last_seen`` keeps one row a key for as long as its time to live after the last change.
Both need the RocksDB state store, which ``use_rocksdb`` sets for a session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OPEN = "start long, last long, events long, first_client string, last_client string"
CLOSED = "session_key string, start timestamp, last_seen timestamp, events long, first_client string, last_client string"
SEEN = "session_key string, first_seen timestamp, last_seen timestamp, events long, first_client string"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def merged(open_sessions: list[tuple], rows: list[tuple], gap: int) -> list[tuple]:
    """Open sessions (start, last, events, first client, last client; microseconds) after some
    (time, client) rows. Of clients at one time the least counts as first, the greatest as last."""
    spans = [(s, e, n, (s, a), (e, b)) for s, e, n, a, b in open_sessions] + [(t, t, 1, (t, c), (t, c)) for t, c in rows]
    out: list[list] = []
    by_client = lambda x: (x[0], x[1] or "")
    for s, e, n, a, b in sorted(spans, key=lambda x: (x[0], x[1])):
        if out and s - out[-1][1] <= gap:
            m = out[-1]
            m[1], m[2], m[3], m[4] = max(m[1], e), m[2] + n, min(m[3], a, key=by_client), max(m[4], b, key=by_client)
        else:
            out.append([s, e, n, a, b])
    return [(s, e, n, a[1], b[1]) for s, e, n, a, b in out]


class SessionProcessor(StatefulProcessor):
    def __init__(self, gap_seconds: float):
        self.gap = round(gap_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", OPEN)

    def _hold(self, sessions: list[tuple]) -> None:
        if sessions:
            self.open.put(sessions)
        else:
            self.open.clear()
        due = {-(-(s[1] + self.gap) // 1000) for s in sessions}
        have = set(self.handle.listTimers())
        for t in have - due:
            self.handle.deleteTimer(t)
        for t in due - have:
            self.handle.registerTimer(t)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(t, None if pd.isna(c) else c) for frame in rows for t, c in zip(frame["at"].tolist(), frame["client"].tolist())]
        self._hold(merged([tuple(s) for s in self.open.get()], new, self.gap))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(s) for s in self.open.get()]
        done = [s for s in held if s[1] + self.gap <= now]
        left = [s for s in held if s[1] + self.gap > now]
        if left:
            self.open.put(left)
        else:
            self.open.clear()
        if done:
            at = lambda k: pd.to_datetime([s[k] for s in done], unit="us")
            yield pd.DataFrame({"session_key": key[0], "start": at(0), "last_seen": at(1), "events": [s[2] for s in done], "first_client": [s[3] for s in done], "last_client": [s[4] for s in done]})

    def close(self) -> None:
        pass


class SeenProcessor(StatefulProcessor):
    """The first and last time, the events and the first client of a key."""

    def __init__(self, ttl_seconds: float | None):
        self.ttl = round(ttl_seconds * 1000) if ttl_seconds else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "first long, last long, events long, client string", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(t, None if pd.isna(c) else c) for frame in rows for t, c in zip(frame["at"].tolist(), frame["client"].tolist())]
        first, client = min(new, key=lambda x: (x[0], x[1] or ""))
        last, n = max(t for t, _ in new), len(new)
        if self.seen.exists():
            held = self.seen.get()
            first, client = min((first, client), (held[0], held[3]), key=lambda x: (x[0], x[1] or ""))
            last, n = max(last, held[1]), n + held[2]
        self.seen.update((first, last, n, client))
        yield pd.DataFrame({"session_key": [key[0]], "first_seen": pd.to_datetime([first], unit="us"), "last_seen": pd.to_datetime([last], unit="us"), "events": [n], "first_client": [client]})

    def close(self) -> None:
        pass


def _rows(events: DataFrame, key: str, ts: str, client: str) -> DataFrame:
    return events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).cast("string").alias("session_key"), F.col(ts).cast("timestamp").alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(client).cast("string").alias("client"))


def closed_sessions(events: DataFrame, gap_seconds: float = 1800, late: str = "1 hour", key: str = "session_id", ts: str = "ts", client: str = "client") -> DataFrame:
    """Sessions of a stream, each once, when it is closed; for append mode."""
    rows = _rows(events, key, ts, client).withWatermark("ts", late)
    return rows.groupBy("session_key").transformWithStateInPandas(SessionProcessor(gap_seconds), CLOSED, "Append", "EventTime")


def last_seen(events: DataFrame, ttl_seconds: float | None = None, key: str = "session_id", ts: str = "ts", client: str = "client") -> DataFrame:
    """The current row of each key that a batch brought events of; for update mode. A key that
    was silent for ``ttl_seconds`` is forgotten and begins anew; such a stream runs by the clock,
    with a processing-time trigger, and does not end by itself."""
    return _rows(events, key, ts, client).groupBy("session_key").transformWithStateInPandas(SeenProcessor(ttl_seconds), SEEN, "Update", "ProcessingTime" if ttl_seconds else "None")


def batch_sessions(events: DataFrame, gap_seconds: float = 1800, key: str = "session_id", ts: str = "ts", client: str = "client") -> DataFrame:
    """The same sessions of a table, by windows."""
    w = F.session_window("ts", f"{gap_seconds} seconds")
    by = F.struct("at", F.coalesce("client", F.lit("")))
    per = _rows(events, key, ts, client).groupBy("session_key", w.alias("w")).agg(F.min("ts").alias("start"), F.max("ts").alias("last_seen"), F.count("*").alias("events"), F.min_by("client", by).alias("first_client"), F.max_by("client", by).alias("last_client"))
    return per.drop("w")
