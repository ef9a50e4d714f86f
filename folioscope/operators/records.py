"""Records and writes: latest-wins upserts, deletes, stages, sessions, conversation memory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.scans import running_before
from folioscope.session import written


def latest(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key: an aggregation that combines before the shuffle, not a window."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*").select(*log.columns)


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """The table with changed and new rows; of several rows of a key the latest wins, a change before an equally old row."""
    both = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return latest(both, keys, [at, "_new"]).drop("_new")


def patch(table: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The table with the given columns replaced where a change has a value."""
    new = changes.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    out = table.join(new, key, "left")
    return out.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns))


def completed(base: DataFrame, derived: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Base rows with the columns that a second pass derives; a row that it leaves out keeps null, a derived value wins over the base's."""
    more = [c for c in derived.columns if c not in keys]
    out = base.join(derived.select(*keys, *(F.col(c).alias(f"_{c}") for c in more)), list(keys), "left")
    return out.select(*(F.coalesce(f"_{c}", c).alias(c) if c in more else F.col(c) for c in base.columns), *(F.col(f"_{c}").alias(c) for c in more if c not in base.columns))


def without(table: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """The table without rows whose keys are listed."""
    return table.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def stale(records: DataFrame, *, status: str, open_states: Sequence[str], alive: DataFrame, key: str, failed: str = "failed") -> DataFrame:
    """Open records that nothing works on any more get the failed status."""
    live = alive.select(key).distinct().withColumn("_live", F.lit(True))
    dead = F.col(status).isin(*open_states) & F.col("_live").isNull()
    return records.join(live, key, "left").withColumn(status, F.when(dead, failed).otherwise(F.col(status))).drop("_live")


def pipeline_status(states: Column, hard: Sequence[str]) -> Column:
    """Status of a run from a map of stage to state: a failed hard stage fails it, a failed soft one makes it partial."""
    failed = F.map_filter(states, lambda _, v: v == "failed")
    hard_failed = F.exists(F.map_keys(failed), lambda k: k.isin(*hard))
    running = F.exists(F.map_values(states), lambda v: v.isin("processing", "queued"))
    return F.when(hard_failed, "failed").when(running, "processing").when(F.size(failed) > 0, "partial").otherwise("completed")


def resume_from(order: Sequence[str], done: Column) -> Column:
    """The stages that are left, in order."""
    return F.array_except(F.array(*map(F.lit, order)), F.coalesce(done, F.array().cast("array<string>")))


def changed(before: DataFrame, after: DataFrame, key: str, content: str) -> DataFrame:
    """(key, change) of rows that are new, changed or gone, by the hash of their content."""
    old = before.select(key, F.xxhash64(content).alias("_old"))
    new = after.select(key, F.xxhash64(content).alias("_new"))
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return old.join(new, key, "full_outer").select(key, kind.alias("change")).where("change IS NOT NULL")


def compaction(messages: DataFrame, *, budget: int, summary: int, stop: int) -> DataFrame:
    """Adds compact: the oldest tool messages of a conversation are cut to a summary of so many characters until half
    of all characters fit the budget; and halted: even then more than `stop`.

    Characters of a conversation are aggregated, and what earlier messages save comes from a scan that splits long conversations.
    Null texts have no characters, a null role is no tool; rows of a null conv_id are one conversation.
    """
    size = F.char_length(F.coalesce("text", F.lit("")))
    saving = F.when(F.col("role") == "tool", F.greatest(size - summary, F.lit(0))).otherwise(0)
    totals = messages.groupBy(F.col("conv_id").alias("_conv")).agg(F.sum(size).alias("_total"))
    rows = running_before(messages.withColumn("_saving", saving), "conv_id", ["turn"], "_saving", "_before")
    rows = rows.join(totals, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    rows = written(rows.withColumn("compact", (F.col("_saving") > 0) & (F.col("_total") / 2 - F.col("_before") / 2 > budget)))
    saved = rows.groupBy(F.col("conv_id").alias("_conv")).agg(F.sum(F.when(F.col("compact"), F.col("_saving")).otherwise(0)).alias("_saved"))
    rows = rows.join(saved, F.col("conv_id").eqNullSafe(F.col("_conv")))
    return rows.select(*messages.columns, "compact", ((F.col("_total") - F.col("_saved")) / 2 > stop).alias("halted"))


def transcript(messages: DataFrame, *, last: int) -> DataFrame:
    """(conv_id, memory): the last turns of each conversation, oldest first, as `role: text` lines."""
    recent = messages.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    kept = messages.join(recent, "conv_id").where(F.col("turn") > F.col("_last") - last)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.concat_ws(": ", m["role"], m["text"]))
    return kept.groupBy("conv_id").agg(F.array_join(lines, "\n").alias("memory"))


def sessions(events: DataFrame, *, gap: str, at: str, who: str) -> DataFrame:
    """(who, started, ended, n): events of one user no further apart than the gap."""
    out = events.groupBy(F.session_window(at, gap).alias("s"), who).agg(F.count("*").alias("n"))
    return out.select(who, F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n")


def newest_runs(runs: DataFrame, *, dataset: str, order: Sequence[Column], keep: int) -> DataFrame:
    """The newest runs of each dataset."""
    return runs.withColumn("_n", F.row_number().over(Window.partitionBy(dataset).orderBy(*order))).where(F.col("_n") <= keep).drop("_n")


def current_runs(runs: DataFrame, *, dataset: str, started: str, keep: int, now: Column, hours: float = 1.0) -> DataFrame:
    """Runs (dataset, full, started) that stay: the newest full ones of each dataset, and single ones no older than some hours."""
    full = newest_runs(runs.where("full"), dataset=dataset, order=[F.desc(started), F.col("run_id")], keep=keep)
    return full.unionByName(runs.where(~F.col("full") & (F.col(started) >= now - F.expr(f"INTERVAL '{int(hours * 3600)}' SECOND"))))


def run_counters(runs: DataFrame) -> DataFrame:
    """(sop_id, runs, failed, last_status, health) of procedures' runs (sop_id, status, at): `good` if at most one in ten failed, `poor` if half did."""
    failed = F.count_if(F.col("status") == "failed")
    out = runs.groupBy("sop_id").agg(F.count("*").alias("runs"), failed.alias("failed"), F.max_by("status", "at").alias("last_status"))
    share = F.col("failed") / F.col("runs")
    return out.withColumn("health", F.when(share <= 0.1, "good").when(share < 0.5, "fair").otherwise("poor"))


def named(records: DataFrame, names: DataFrame, key: str, name: str, *, unknown: str = "") -> DataFrame:
    """Records with the name of a key, as of who sent them; keys without one get the given text."""
    return records.join(names.select(key, name), key, "left").withColumn(name, F.coalesce(name, F.lit(unknown)))
