"""A pool of sessions as streaming state: memory of a conversation while it is active, eviction by timer.

Requests of one scope share a session, whose state is its history and the time it was last active. A timer that each
request sets anew ends it, a time to live after the last one, whether or not other requests come: the history is emitted as evicted, and the next
request of the scope begins a new session. State and timers are in the checkpoint, so a restarted stream goes on with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds that a session lives without a request; messages of a history that are remembered.
TTL_SECONDS, REMEMBERED = 2 * 3600, 20
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RESULT = "session_key string, session long, event string, ms long, turns long, memory string"
COLUMNS = ["session_key", "session", "event", "ms", "turns", "memory"]
#: The time of a session that isn't there.
NONE = -(1 << 62)


def session_key(scene: Column, session_id: Column, library_id: Column, doc_ids: Column) -> Column:
    """scene:session:hash of the scope; another library or set of documents is another session. Null and empty parts are `default`,
    the order of documents doesn't count."""
    library = F.coalesce(F.nullif(library_id, F.lit("")), F.lit("default"))
    ids = F.array_sort(F.coalesce(doc_ids, F.array().cast("array<string>")))
    scope = F.substring(F.sha1(F.array_join(F.concat(F.array(library), ids), "|")), 1, 8)
    return F.concat_ws(":", scene, F.coalesce(F.nullif(session_id, F.lit("")), F.lit("default")), scope)


class SessionPool(StatefulProcessor):
    """Handles the requests (session_key, ms, role, text) of one key: it emits one row a request and one at eviction.

    Event time drives it: a session ends when the watermark passes its last request by the time to live, or when the next request of its
    key comes later than that. Requests of one batch are taken in the order of their time; state is read and written once for all of them.
    """

    def __init__(self, ttl_seconds: int = TTL_SECONDS, remembered: int = REMEMBERED):
        self.ttl, self.remembered = ttl_seconds * 1000, remembered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: Number of the session, requests in it, time of the last one; a number with a time of NONE is that of an ended session.
        self.session = handle.getValueState("session", "number long, turns long, last long")
        self.history = handle.getListState("history", "role string, text string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        requests = pd.concat(list(rows)).sort_values(["ms", "role", "text"], kind="stable", na_position="first")
        number, turns, last = self.session.get() if self.session.exists() else (0, 0, NONE)
        before = last
        history = list(self.history.get()) if last != NONE else []
        out: list[tuple] = []
        for now, role, text in zip(requests["ms"], requests["role"], requests["text"], strict=True):
            if last != NONE and now > last + self.ttl:
                out.append((key[0], number, "evicted", last + self.ttl, turns, _memory(history)))
                turns, last, history = 0, NONE, []
            if last == NONE:
                number += 1
            history = [*history, (role or "", text or "")][-self.remembered :]
            turns, last = turns + 1, max(now, last)
            out.append((key[0], number, "request", now, turns, _memory(history)))
        if before != last:
            if before != NONE:
                self.handle.deleteTimer(int(before + self.ttl))
            self.handle.registerTimer(int(last + self.ttl))
        self.session.update((int(number), int(turns), int(last)))
        self.history.put([tuple(h) for h in history])
        yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        number, turns, last = self.session.get()
        if last != NONE:
            yield pd.DataFrame([(key[0], number, "evicted", last + self.ttl, turns, _memory(list(self.history.get())))], columns=COLUMNS)
            self.session.update((number, 0, NONE))  # the number stays, so that the next session gets another
            self.history.clear()

    def close(self) -> None:
        pass


def _memory(history: list[tuple[str, str]]) -> str:
    return "\n".join(f"{role}: {text}" for role, text in history)


def session_pool(requests: DataFrame, *, late: str, ttl_seconds: int = TTL_SECONDS, remembered: int = REMEMBERED) -> DataFrame:
    """A stream of requests (session_key, at, role, text) as a stream of (session_key, session, event, at, turns, memory).

    Requests later than `late` are left out, as are those without a time. Null keys share a session, ''; null roles and texts are
    empty. Needs the RocksDB state store (PROVIDER) in spark.sql.streaming.stateStore.providerClass.
    """
    rows = requests.select(F.coalesce("session_key", F.lit("")).alias("session_key"), F.col("at").cast("timestamp").alias("at"), "role", "text").where("at IS NOT NULL")
    grouped = rows.withColumn("ms", F.unix_millis("at")).withWatermark("at", late).groupBy("session_key")
    out = grouped.transformWithStateInPandas(SessionPool(ttl_seconds, remembered), RESULT, "Append", "EventTime")
    return out.select("session_key", "session", "event", F.timestamp_millis("ms").alias("at"), "turns", "memory")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that are started within use the RocksDB state store; the session's own choice comes back after."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
