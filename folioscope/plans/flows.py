"""Streams and writes, run to their end and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.plans.registry import Tables, query
from folioscope.session import work_dir
from folioscope.sources import sinks
from folioscope.streaming import events, pool


@query("stream_window_counts", "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS started, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_window_counts(t: Tables) -> DataFrame:
    counts = events.window_counts(events.file_stream(t.spark, t.folder, "events"), at="ts", kind="event_type", value="value", size="6 hours", late="1 day")
    out = events.run_once(counts, work_dir(t.spark), mode="complete")
    return out.select(F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_latest_state", "SELECT user_id, max_by(event_type, struct_pack(a := ts, b := event_id)) AS event_type, max_by(event_id, struct_pack(a := ts, b := event_id)) AS event_id FROM events GROUP BY user_id")
def stream_latest_state(t: Tables) -> DataFrame:
    stream = events.file_stream(t.spark, t.folder, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "event_type", "event_id")
    return events.keep_latest(stream, work_dir(t.spark), keys=["user_id"], at="at").select("user_id", "event_type", "event_id")


@query("stream_distinct", "SELECT event_id, event_type FROM events")
def stream_distinct(t: Tables) -> DataFrame:
    stream = events.distinct_events(events.file_stream(t.spark, t.folder, "events"), key="event_id", at="ts", late="30 days")
    return events.run_once(stream.select("event_id", "event_type"), work_dir(t.spark))


@query("partition_replace", "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN n_name || ' (new)' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_regionkey <> 2 OR n_nationkey % 2 = 0")
def partition_replace(t: Tables) -> DataFrame:
    folder = work_dir(t.spark)
    sinks.replace_partitions(t.nation, folder, "n_regionkey")
    sinks.replace_partitions(t.nation.where("n_regionkey = 2 AND n_nationkey % 2 = 0").withColumn("n_name", F.concat("n_name", F.lit(" (new)"))), folder, "n_regionkey")
    return t.spark.read.schema(t.nation.schema).parquet(folder).select("n_nationkey", "n_name", "n_regionkey")


@query("subset_export", "SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_custkey % 100 = 7 UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_custkey % 100 = 7")
def subset_export(t: Tables) -> DataFrame:
    folder = work_dir(t.spark)
    scope = t.customer.where("c_custkey % 100 = 7").select(F.col("c_custkey").alias("custkey"))
    tables = {"orders": t.orders.withColumn("custkey", F.col("o_custkey")), "customer": t.customer.withColumn("custkey", F.col("c_custkey"))}
    sinks.export_subset(tables, scope, "custkey", folder)
    parts = [t.spark.read.schema(rows.schema).parquet(f"{folder}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, rows in tables.items()]
    return parts[0].unionByName(parts[1])


@query(
    "faithful_markdown",
    """WITH {blocks} SELECT doc_id, string_agg(CASE block_type WHEN 'title' THEN repeat('#', CAST(title_level AS INT)) || ' ' || text WHEN 'list_item' THEN '- ' || text WHEN 'formula' THEN '$$' || chr(10) || text || chr(10) || '$$' ELSE text END, chr(10) || chr(10) ORDER BY pos) AS body FROM blocks GROUP BY doc_id""",
)
def faithful_markdown(t: Tables) -> DataFrame:
    return sinks.markdown(t.blocks)


@query(
    "session_evictions",
    """WITH timed AS (SELECT CAST(user_id AS VARCHAR) AS session_key, epoch_us(ts) // 1000 AS ms, event_type, lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_type, event_id) AS before, event_id FROM events),
       numbered AS (SELECT *, sum(CASE WHEN before IS NULL OR ms > before + 7200000 THEN 1 ELSE 0 END) OVER (PARTITION BY session_key ORDER BY ms, event_type, event_id) AS session FROM timed),
       ended AS (SELECT session_key, CAST(session AS BIGINT) AS session, count(*) AS turns, max(ms) + 7200000 AS ended, string_agg('user: ' || event_type, chr(10) ORDER BY ms, event_type) AS memory, max(session) OVER (PARTITION BY session_key) AS last FROM numbered GROUP BY session_key, session)
       SELECT session_key, session, turns, CAST(ended AS BIGINT) AS ended, md5(memory) AS memory FROM ended WHERE session < last OR ended <= (SELECT max(ms) FROM timed)""",
)
def session_evictions(t: Tables) -> DataFrame:
    """Sessions of users that a pool let go two hours after their last event, by timer or by the next event, with what they remembered."""
    folder = work_dir(t.spark)
    stream = events.file_stream(t.spark, t.folder, "events")
    requests = stream.select(F.col("user_id").cast("string").alias("session_key"), F.col("ts").alias("at"), F.lit("user").alias("role"), F.col("event_type").alias("text"))
    with pool.rocksdb(t.spark):
        rows = events.run_once(pool.session_pool(requests, late="0 seconds", remembered=1 << 30), folder)
    return rows.where("event = 'evicted'").select("session_key", "session", "turns", F.unix_millis("at").alias("ended"), F.md5("memory").alias("memory"))
