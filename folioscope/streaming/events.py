"""Event streams: counts in windows, sessions, latest states, with watermarks for late events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from folioscope.operators.records import latest


def file_stream(spark: SparkSession, folder: str, name: str, *, per_trigger: int = 8) -> DataFrame:
    """A table of a folder as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def timed(events: DataFrame, at: str, late: str) -> DataFrame:
    """Events with a watermark on their time, which may be stored without a zone."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def window_counts(events: DataFrame, *, at: str, kind: str, value: str, size: str, late: str) -> DataFrame:
    """Number and sum by kind in tumbling windows; events later than `late` are left out."""
    grouped = timed(events, at, late).groupBy(F.window(at, size).alias("w"), kind)
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("started"), kind, "n", "total")


def session_counts(events: DataFrame, *, at: str, who: str, gap: str, late: str) -> DataFrame:
    """Sessions of each user: events no further apart than the gap."""
    grouped = timed(events, at, late).groupBy(F.session_window(at, gap).alias("s"), who)
    return grouped.agg(F.count("*").alias("n")).select(who, F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n")


def distinct_events(events: DataFrame, *, key: str, at: str, late: str) -> DataFrame:
    """First event of each key within the watermark."""
    return timed(events, at, late).dropDuplicatesWithinWatermark([key])


def run_once(stream: DataFrame, folder: str, *, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote; with mode `complete`, the last state."""
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{folder}/out").start().awaitTermination()
    else:
        writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/out")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def keep_latest(stream: DataFrame, folder: str, *, keys: list[str], at: str) -> DataFrame:
    """Upserts a stream into a table of latest rows, kept as a log: a batch adds the latest row of each of its keys, in a folder of
    its own, so its cost is that of the batch; one that is run again writes the same folder again. A read takes the latest of all
    (compacted writes that once, where the log has grown long)."""
    spark, log = stream.sparkSession, f"{folder}/log"

    def add(batch: DataFrame, number: int) -> None:
        latest(batch, keys, [at]).write.mode("overwrite").parquet(f"{log}/batch={number}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):  # no batch yet, neither in this run nor in one before
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(log)
    return latest(rows, keys, [at, "batch"]).select(*stream.columns)


def compacted(table: DataFrame, folder: str) -> None:
    """Writes the latest rows as the first batch of a new log, in another folder than the log that the table was read from: a
    write can't replace what it reads."""
    table.write.mode("overwrite").parquet(f"{folder}/log/batch=0")


def in_batches(stream: DataFrame, handle: Callable[[DataFrame], None], folder: str) -> None:
    """Hands each micro-batch to a function."""
    stream.writeStream.foreachBatch(lambda batch, _: handle(batch)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
