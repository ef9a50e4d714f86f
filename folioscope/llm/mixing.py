"""Mixing sources to target weights, in DataFrame operations only.

Words are summed per source, targets are filled by weight up to a cap, and each document is emitted
floor(rate) times plus one more time with a probability of the fraction, decided by a hash of its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import free_name, materialize

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: Times that a source may be repeated at most.
MOST = 3
#: Bytes of the table of sources up to which it is sent to every task; beyond, it is joined by a shuffle.
BROADCAST_BYTES = 8 << 20


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """Rows with their number (from 0) in the given order, counted per range partition: no task holds all."""
    ranged = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    counts = {r[0]: r[1] for r in ranged.groupBy(part).count().collect()}  # one row a partition
    before, offsets = 0, []
    for p in sorted(counts):
        offsets += [F.lit(p).cast("long"), F.lit(before).cast("long")]
        before += counts[p]
    base = F.element_at(F.create_map(*offsets), part) if offsets else F.lit(0)
    return ranged.withColumn("number", base + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size) rows; sources are ordered by code point, null last.

    All words are shared by weight. A target stops at `most` times its source's size; what is above goes
    to the other sources by weight, until none is above. Each round is one aggregation over the sources,
    and a round ends all sources that are above, so there are few. No words at all: targets of 0.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = numbered(sums, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.select("source", "source_size", weight.cast("long").alias("weight"), (most * F.col("source_size")).alias("cap")))
    level = 0.0
    while True:
        free = F.col("cap") / F.col("weight") >= level
        total, capped, left = ranked.agg(F.sum("source_size"), F.sum(F.when(~free, F.col("cap"))), F.sum(F.when(free, F.col("weight")))).first()
        after = ((total or 0) - (capped or 0)) / left if left else level
        if after <= level:
            break
        level = after
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level))
    return ranked.select("source", "source_size", target.alias("target"))


def copies(doc_id: Column, rate: Column, seed: str = "mix") -> Column:
    """floor(rate), plus one with a probability of the rest: the same for each run and each row of an id."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")


def mixed(docs: DataFrame, *, seed: str = "mix") -> DataFrame:
    """Packed documents with what the mix takes: (row: struct of the columns, size, source_size, target, copies).

    What a source takes differs from its target by the draws alone: its expectation is the target, its standard
    deviation at most half the root of the sum of its squared sizes, so by little where no document is
    a large part of its source.
    The source of null is one of its own, after all others. Texts of null and without words have size 0;
    they are copied like the others of their source, or not at all if their source has no words.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    rows = rows.select("row", word_count(F.col("row.text")).alias("size"))
    targets = source_targets(rows.select(F.col("row.source").alias("source"), "size"))
    size = targets.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        targets = F.broadcast(targets)
    joined = rows.join(targets, F.col("row.source").eqNullSafe(F.col("source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return joined.select("row", "size", "source_size", "target", copies(F.col("row.doc_id"), rate, seed).alias("copies"))


def mix_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words that the mix takes, repeats counted)."""
    out = mixed(docs.select("doc_id", "text", "source"))
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as the mix takes it, numbered from 1 in a last column `copy`."""
    out = mixed(docs)
    name = free_name("copy", docs.columns)
    numbers = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias(name)
    return out.where("copies > 0").select("row", numbers).select(*(F.col("row")[c].alias(c) for c in docs.columns), name)
