"""Running sums over groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import written


def running_before(rows: DataFrame, key: str, order: Sequence[str | Column], value: str, name: str) -> DataFrame:
    """Rows with the sum of `value` over the rows of their key that come before them; nulls add nothing.

    Rows are dealt by range of key and order, so a large group is spread over tasks. A window sums within a key's rows of one
    task, and what the tasks before hold of the key, a row a task, is summed and joined. Of rows that the order doesn't tell apart, either may come first.
    """
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = rows.repartitionByRange(F.col(key), *by).sortWithinPartitions(F.col(key), *by)
    ranged = written(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    within = Window.partitionBy("_part", key).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_local", F.coalesce(F.sum(value).over(within), F.lit(0)))
    before = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_of")).agg(F.sum(value).alias("_sum"))
    parts = parts.withColumn("_carried", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    joined = local.join(parts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_of")))
    return joined.select(*rows.columns, (F.col("_local") + F.col("_carried")).alias(name))
