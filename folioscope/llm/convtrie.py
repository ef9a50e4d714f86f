"""Trie of conversation prefixes, with the tokens that sharing each subtree saves.

A node is a distinct sequence of first turns; the conversations that start with it are its members, and the smallest
member owns it. As a member of a node is a member of all nodes above, a conversation owns a suffix of its own path,
possibly an empty one. So sums over a subtree need no walk down the tree: over the members of a node, tokens of all
occurrences minus tokens of owned nodes give what the subtree saves, flags of owned leaves give its leaves, and flags of an owned next node its
children. All of these come from one aggregation by prefix, which Spark combines before it shuffles.

Prefixes are told by three sums of 52 bits of SHA-256 over (position, turn), modulo 2**52. The sums run along a conversation in
blocks of BLOCK turns: a window never holds more than a block, and block totals are summed by the same step again. Numbers of turns come from range partitions. So one very
long conversation is spread over tasks like many short ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import materialize, small_batches
from folioscope.llm.mixing import numbered, word_count

#: Conversations that share a base: c begins with turns of c - c % EVERY, as many as crc32 of c modulo SHARED says.
EVERY, SHARED = 20, 4
#: Turns, or blocks, that one window sums.
BLOCK = 512
MODULUS = 1 << 52
#: Bytes of conversation ids that one block of a node's list holds, about.
LIST_BYTES = 1 << 18
KEYS = ["k1", "k2", "k3"]


# ---------------------------------------------------------------- turns and rebuilt conversations


def ordered_turns(messages: DataFrame) -> DataFrame:
    """(conv_id, digest, words, number): turns in the order of conversation and turn (null first), ties by the SHA-256 of role and text.

    Null roles and texts are empty; rows of a null conv_id belong to no conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = messages.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"), word_count(text).alias("words")
    )
    # written first: partitioning by range reads its input twice
    return numbered(materialize(rows), F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("digest").asc())


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations with the first turns of their base in place of their own: (conv_id, length), (conv_id, depth, length, digest, words).

    A conversation that is its own base stays as it is. An absent base gives no turns, a short one all it has.
    """
    own = turns.groupBy("conv_id").agg(F.min("number").alias("start"), F.count(F.lit(1)).alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % EVERY
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    own = materialize(own.select("conv_id", "start", "n", base.alias("base"), F.when(base == F.col("conv_id"), F.lit(0)).otherwise(shared).alias("cut")))
    bases = own.where("conv_id = base").select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = own.join(bases, "base", "left").withColumn("lead", F.least("cut", F.coalesce("base_n", F.lit(0))))
    convs = materialize(convs.withColumn("length", F.col("lead") + F.greatest(F.col("n") - F.col("cut"), F.lit(0))).select("conv_id", "start", "base", "cut", "lead", "length"))
    at = F.col("number") - F.col("start")
    placed = turns.join(convs, "conv_id").withColumn("at", at)
    rest = placed.where("at >= cut").select("conv_id", (F.col("at") - F.col("cut") + F.col("lead") + 1).alias("depth"), "length", "digest", "words")
    heads = placed.where((F.col("conv_id") == F.col("base")) & (F.col("at") < SHARED - 1)).select("base", "at", "digest", "words")
    led = convs.where("lead > 0").select("conv_id", "base", "lead", "length").join(heads, "base").where("at < lead")
    lead = led.select("conv_id", (F.col("at") + 1).alias("depth"), "length", "digest", "words")
    return convs.select("conv_id", "length"), materialize(rest.unionByName(lead))


# ---------------------------------------------------------------- prefixes


def running_sums(rows: DataFrame, at: str, names: list[str], longest: int) -> DataFrame:
    """Rows of (conv_id, at, names) with each name replaced by its sum up to the row within its conversation; names in KEYS modulo MODULUS.

    `at` counts from 1 up to at most `longest`. Windows hold BLOCK rows; the totals of blocks are summed in the same
    way, so there are as many steps as `longest` has digits to the base BLOCK.
    """

    def wrapped(name: str, c: Column) -> Column:
        return c % MODULUS if name in KEYS else c

    block = F.floor((F.col(at) - 1) / BLOCK)
    window = Window.partitionBy("conv_id", "block").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("block", block)
    summed = rows.select(*(c for c in rows.columns if c not in names), *(wrapped(c, F.sum(c).over(window)).alias(c) for c in names))
    if longest <= BLOCK:
        return summed.drop("block")
    totals = rows.groupBy("conv_id", "block").agg(*(wrapped(c, F.sum(c)).alias(c) for c in names))
    before = materialize(running_sums(totals.withColumn("place", F.col("block") + 1).drop("block"), "place", names, -(-longest // BLOCK)))
    before = before.select("conv_id", F.col("place").alias("block"), *(F.col(c).alias(f"before_{c}") for c in names))
    joined = summed.join(before, ["conv_id", "block"], "left")
    kept = [c for c in summed.columns if c not in names and c != "block"]
    return joined.select(*kept, *(wrapped(c, F.col(c) + F.coalesce(f"before_{c}", F.lit(0))).alias(c) for c in names))


def prefixes(path: DataFrame, longest: int) -> DataFrame:
    """(conv_id, depth, length, words, k1..k3: the prefix up to the turn, p1..p3: the one before it, tokens: words up to the turn)."""
    mixed = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), "digest"), 256)
    terms = [F.conv(F.substring(mixed, 1 + 13 * i, 13), 16, 10).cast("long") for i in range(3)]
    rows = path.select("conv_id", "depth", "length", "words", *(t.alias(f"t{i + 1}") for i, t in enumerate(terms)))
    rows = rows.select("*", *(F.col(f"t{i}").alias(f"k{i}") for i in (1, 2, 3)), F.col("words").alias("tokens"))
    out = running_sums(rows, "depth", [*KEYS, "tokens"], longest)
    before = [((F.col(f"k{i}") - F.col(f"t{i}") + MODULUS) % MODULUS).alias(f"p{i}") for i in (1, 2, 3)]
    return out.select("conv_id", "depth", "length", "words", "tokens", *KEYS, *before)


# ---------------------------------------------------------------- digests of member lists


def member_digests(ends: DataFrame) -> DataFrame:
    """(k1..k3, ends_sha256) from (k1..k3, conv_id): SHA-256 of each node's ids, ascending, comma-joined.

    Ranges of (node, id) join their ids to lists of about LIST_BYTES; a node's digest reads its lists one after
    another, so a node at which a third of all conversations end costs one task a few large strings, of which it holds one at a time.
    """
    small_batches(ends.sparkSession)
    keys = ", ".join(f"{k} long" for k in KEYS)

    def key(row: tuple) -> tuple:
        return row[:3]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    def batch(out: list[tuple], names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: [r[i] for r in out] for i, n in enumerate(names)})

    def lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, ids, size = None, 0, [], 0
        names = [*KEYS, "first", "ids"]
        for row in rows(batches):
            if ids and (key(row) != node or size >= LIST_BYTES):
                yield batch([(*node, first, ",".join(ids))], names)
                ids, size = [], 0
            if not ids:
                node, first = key(row), row[3]
            ids.append(str(row[3]))
            size += len(ids[-1]) + 1
        if ids:
            yield batch([(*node, first, ",".join(ids))], names)

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        names = [*KEYS, "ends_sha256"]
        for row in rows(batches):
            if key(row) == node:
                state.update(b",")
            else:
                if node is not None:
                    yield batch([(*node, state.hexdigest())], names)
                node, state = key(row), hashlib.sha256()
            state.update(row[4].encode())
        if node is not None:
            yield batch([(*node, state.hexdigest())], names)

    parts = ends.repartitionByRange(*KEYS, "conv_id").sortWithinPartitions(*KEYS, "conv_id").mapInArrow(lists, f"{keys}, first long, ids string")
    return parts.repartition(*KEYS).sortWithinPartitions(*KEYS, "first").mapInArrow(digests, f"{keys}, ends_sha256 string")


# ---------------------------------------------------------------- the trie


def owned_suffixes(convs: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv_id, length, from_depth: first depth that it owns, shared_tokens: words of its path above, leaf: 1 if it owns a leaf).

    A conversation owns the last nodes of its path, so their number and words tell where they begin.
    """
    owned = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.count(F.lit(1)).alias("n_owned"), F.sum("words").alias("owned_tokens"), F.max(F.col("childless").cast("long")).alias("leaf"))
    sums = rows.groupBy("conv_id").agg(F.sum("words").alias("all_tokens"))
    all_ = convs.join(sums, "conv_id", "left").join(owned, "conv_id", "left").fillna(0)
    return all_.select("conv_id", "length", (F.col("length") + 1 - F.col("n_owned")).alias("from_depth"), (F.col("all_tokens") - F.col("owned_tokens")).alias("shared_tokens"), "leaf")


def trie(messages: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is known by its owner and its depth. Turns of one number are ordered by the SHA-256 of role and text; repeated
    rows are turns of their own. Without a conversation (a table that is empty or has null ids alone) there is no node, not even the root.
    """
    turns = ordered_turns(messages)
    convs, path = rebuilt(turns)
    longest, root_owner = convs.agg(F.max("length"), F.min("conv_id")).first()
    rows = materialize(prefixes(path, max(1, longest or 0)))
    last = F.col("depth") == F.col("length")
    nodes = rows.groupBy("depth", *KEYS).agg(F.min("conv_id").alias("owner"), F.min("words").alias("words"), F.min(last).alias("childless"))
    nodes = materialize(nodes)
    suffixes = materialize(owned_suffixes(convs, rows, nodes))

    joined = rows.join(suffixes.drop("length"), "conv_id")
    above = F.greatest(F.col("shared_tokens") - (F.col("tokens") - F.col("words")), F.lit(0))
    owns_next = (F.col("from_depth") <= F.col("depth") + 1) & ~last
    sums = joined.groupBy("depth", *KEYS).agg(
        F.min(F.struct("conv_id", "from_depth", "p1", "p2", "p3")).alias("top"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(owns_next.cast("long")).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(above).alias("saved_tokens"),
    )
    ends = rows.where(last).select(*KEYS, "conv_id")
    turnless = convs.where("length = 0").select(*(F.lit(0).cast("long").alias(k) for k in KEYS), "conv_id")
    digests = materialize(member_digests(ends.unionByName(turnless)))
    no_one = hashlib.sha256().hexdigest()
    counts = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    shown = sums.join(digests, KEYS, "left").select("depth", "top.*", *counts, F.coalesce("ends_sha256", F.lit(no_one)).alias("ends_sha256"))
    shown = materialize(shown)

    # the owner of a node's parent is its own owner, but where the owned suffix begins
    out = ["conv_id", "depth", "parent_conv_id", *counts, "ends_sha256"]
    inner = shown.where("from_depth < depth").withColumn("parent_conv_id", F.col("conv_id"))
    second = shown.where("from_depth >= depth AND depth = 1").withColumn("parent_conv_id", F.lit(root_owner).cast("long"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), *(F.col(k).alias(f"p{k[1]}") for k in KEYS), F.col("owner").alias("parent_conv_id"))
    heads = shown.where("from_depth >= depth AND depth > 1").join(parents, ["depth", "p1", "p2", "p3"])
    below = reduce(DataFrame.unionByName, (part.select(*out) for part in (inner, second, heads)))

    root = suffixes.agg(
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(((F.col("from_depth") <= 1) & (F.col("length") >= 1)).cast("long")).alias("n_children"),
        F.greatest(F.sum("leaf"), F.lit(1)).alias("n_leaves"),
        F.sum("shared_tokens").alias("saved_tokens"),
    )
    root = root.where("n_convs > 0").select("*", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), *(F.lit(0).cast("long").alias(k) for k in KEYS))
    root = root.join(digests, KEYS, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(no_one))).select(*out)
    return below.unionByName(root)
