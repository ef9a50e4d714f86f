"""The pool of sessions: eviction by timer, restart from the checkpoint, remembered history."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from folioscope.streaming import pool
from folioscope.streaming.pool import session_key, session_pool

START = dt.datetime(2024, 1, 1)
SCHEMA = "session_key string, at timestamp, role string, text string"


class Flow:
    """Batches of requests that are put into a folder, and runs of the stream over it from one checkpoint."""

    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options, self.batches = spark, folder, options, 0

    def run(self, *requests):
        """New rows of (key, session, event, seconds, turns, memory) after a batch; the stream is started anew for it."""
        rows = [(k, None if s is None else START + dt.timedelta(seconds=s), r, x) for k, s, r, x in requests]
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{self.folder}/in/batch{self.batches}")
        seen = self._out()
        self.batches += 1
        with pool.rocksdb(self.spark):
            stream = session_pool(self.spark.readStream.schema(SCHEMA).parquet(f"{self.folder}/in/*"), late="0 seconds", **self.options)
            stream.writeStream.outputMode("append").option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).format("parquet").option("path", f"{self.folder}/out").start().awaitTermination()
        return sorted(x for x in self._out() if x not in seen)

    def _out(self):
        if not self.batches:
            return []
        rows = self.spark.read.schema("session_key string, session long, event string, at timestamp, turns long, memory string").parquet(f"{self.folder}/out").collect()
        return [(r["session_key"], r["session"], r["event"], (r["at"] - START).total_seconds(), r["turns"], r["memory"]) for r in rows]


@pytest.fixture
def flow(spark, tmp_path):
    return lambda **options: Flow(spark, str(tmp_path), **options)


def test_eviction_by_timer_and_restart(flow):
    f = flow(ttl_seconds=60)
    assert f.run(("a", 0, "user", "hi"), ("b", 5, "user", "x"), ("a", 10, "assistant", "hello")) == [
        ("a", 1, "request", 0, 1, "user: hi"), ("a", 1, "request", 10, 2, "user: hi\nassistant: hello"), ("b", 1, "request", 5, 1, "user: x"),
    ]
    # started anew, the state is there: b goes on, a's timer runs out as the watermark passes 70
    assert f.run(("b", 50, "user", "y"), ("c", 80, "user", "z")) == [
        ("a", 1, "evicted", 70, 2, "user: hi\nassistant: hello"), ("b", 1, "request", 50, 2, "user: x\nuser: y"), ("c", 1, "request", 80, 1, "user: z"),
    ]
    # the next request of an evicted scope begins a new session, without memory of the old one
    assert f.run(("a", 200, "user", "again")) == [("a", 2, "request", 200, 1, "user: again"), ("b", 1, "evicted", 110, 2, "user: x\nuser: y"), ("c", 1, "evicted", 140, 1, "user: z")]


def test_a_late_enough_request_ends_the_session_itself(flow):
    assert flow(ttl_seconds=60).run(("a", 0, "user", "1"), ("a", 60, "user", "2"), ("a", 121, "user", "3"), ("b", 121, None, None)) == [
        ("a", 1, "evicted", 120, 2, "user: 1\nuser: 2"), ("a", 1, "request", 0, 1, "user: 1"), ("a", 1, "request", 60, 2, "user: 1\nuser: 2"), ("a", 2, "request", 121, 1, "user: 3"), ("b", 1, "request", 121, 1, ": "),
    ]


def test_memory_keeps_the_last_messages(flow):
    got = flow(ttl_seconds=60, remembered=2).run(*(("a", i, "user", str(i)) for i in range(4)), (None, 1, "user", "no key"), ("a", None, "user", "no time"))
    assert [r[5] for r in got if r[0] == "a"] == ["user: 0", "user: 0\nuser: 1", "user: 1\nuser: 2", "user: 2\nuser: 3"]
    assert [r for r in got if r[0] == ""] == [("", 1, "request", 1, 1, "user: no key")]


def test_session_key(spark):
    rows = [("chat", "s1", "lib", ["b", "a"]), ("chat", "s1", "lib", ["a", "b"]), ("chat", "s1", "lib", ["a"]), ("chat", None, "", None)]
    keys = spark.createDataFrame(rows, "scene string, id string, lib string, docs array<string>").select(session_key(F.col("scene"), F.col("id"), F.col("lib"), F.col("docs"))).collect()
    scope = lambda *parts: hashlib.sha1("|".join(parts).encode()).hexdigest()[:8]
    assert [r[0] for r in keys] == [f"chat:s1:{scope('lib', 'a', 'b')}"] * 2 + [f"chat:s1:{scope('lib', 'a')}", f"chat:default:{scope('default')}"]
