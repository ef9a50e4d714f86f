"""Jaccard self-join over word n-grams with Bayesian candidate pruning.

1. Texts become sets of hashed five-word shingles; equal sets are one class with a representative, and each
   representative gets MinHash values, worked out once and carried along from then on.
2. Bands of values put representatives into buckets. Pairs of a bucket, in blocks where it is large, are
   compared in their first common band only: values some at a time, and a pair goes as soon as the posterior
   probability that its similarity reaches the threshold, given the matches so far and a uniform prior, falls below the
   tolerance. What leaves a block is who has a pair left, and a forest of these pairs: no pairs.
3. Components of the forests hold texts that are all but surely similar to one another or linked by such. Only their members get
   their shingles fetched, once for a component that fits a block. A larger one is verified by pairs of blocks, or by its
   buckets, whichever sends fewer sets: blocks for many copies of one text, buckets for long chains.
4. Pairs that last are verified on the exact sets. Only counts and a forest of the links leave a block, and components over them are the groups.

Buckets, components and classes, of which one may hold very many rows, are tables that are written before they
are joined to the rows, so that both sides of the join are shuffled and Spark can split such a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import U64, Words, group_starts, materialize, mix, slabs, small_batches, text_bytes, whole_groups

SHINGLE = 5
THRESHOLD = 0.8
#: 26 bands of 4 values miss a pair at the threshold with a probability of about 1e-6.
BANDS, ROWS = 26, 4
#: Values compared before each look at the posterior; fewer than 16 could not drop a pair at this tolerance.
STEP = 16
TOLERANCE = 1e-7
#: Representatives of a bucket or component that one block holds, and their shingles (a longer set is a block by itself).
BLOCK, BLOCK_SHINGLES = 512, 1 << 18
#: Pairs that are compared at once.
PAIRS = 1 << 18


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, in one array, with the offsets of the rows.

    Words are those of common.Words. A row with fewer words than a shingle has one shingle of them all.
    """
    words = Words(data, offsets)
    n = len(words.hashes)
    seeds = _seeds(size)
    shingles = np.zeros(n, U64)
    for k in range(min(size, n)):
        shingles[: n - k] += words.hashes[k:] * seeds[k]
    first = words.first
    out, ends = [], [0]
    shingles = mix(shingles)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            own = np.unique(shingles[a : b - size + 1])
        elif b > a:
            own = mix((words.hashes[a:b] * seeds[: b - a]).sum(keepdims=True, dtype=U64) + U64(b - a))
        else:
            own = shingles[:0]
        out.append(own)
        ends.append(ends[-1] + len(own))
    return np.concatenate([*out, shingles[:0]]), np.array(ends)


def signatures(sets: np.ndarray, ends: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """MinHash values of each row, of 16 bits, those of a band in one integer: rows x bands. Rows without shingles get zeros."""
    full = np.flatnonzero(np.diff(ends) > 0)
    out = np.zeros((len(ends) - 1, bands), U64)
    if len(full):
        at = ends[full]
        for k, seed in enumerate(_seeds(bands * ROWS)):
            value = np.minimum.reduceat(sets * seed, at) >> U64(32) & U64(0xFFFF)  # the low bits: high ones of a minimum are small
            out[full, k // ROWS] |= value << U64(16 * (k % ROWS))
    return out


def set_prints(sets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each row's set."""
    sums = np.concatenate((np.zeros(1, U64), np.cumsum(sets, dtype=U64)))[ends]
    return mix(sums[1:] - sums[:-1]).view(np.int64)


FEATURES = "doc long, mark long, print long, print2 long, size long, bands array<long>"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set hashes and MinHash values of each text; none for texts without words."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("body"))
        for lo, hi in slabs(offsets):
            sets, ends = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            prints = [set_prints(sets, ends), set_prints(mix(sets + U64(1)), ends)]
            full = np.diff(ends) > 0
            own = [batch.column(c).slice(lo, hi - lo).filter(pa.array(full)) for c in ("doc", "mark")]
            flat = pa.array(signatures(sets, ends)[full].view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, full.sum() * BANDS + 1, BANDS, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([*own, pa.array(prints[0][full]), pa.array(prints[1][full]), pa.array(np.diff(ends)[full].astype(np.int64)), lists], names=["doc", "mark", "print", "print2", "size", "bands"])


@cache
def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Fewest matches among n MinHash values that keep a pair: P(similarity >= threshold | matches) >= tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), and its upper tail at t is P(Bin(n + 1, t) <= m).
    """
    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


def pair_chunks(starts: list[int], own: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows to be compared within the groups that begin at `starts`, some at a time: of one block each pair once, of two blocks
    those between them. Rows of a group are sorted by their block."""
    n = len(own)
    ends = np.repeat([*starts[1:], n], np.diff([*starts, n]))
    place = np.arange(n)
    same = low == high
    firsts = np.zeros(n + 1, np.int64)
    np.cumsum(own == low, out=firsts[1:])
    begin = np.repeat(starts, np.diff([*starts, n]))
    second = begin + firsts[ends] - firsts[begin]  # where the rows of the second block begin
    to = np.where(same, place + 1, second)
    count = np.where(same | (own == low), ends - to, 0)
    total = np.concatenate(([0], np.cumsum(count)))
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PAIRS, "right")) - 1)
        i = np.repeat(place[lo:hi], count[lo:hi])
        yield i, np.repeat(to[lo:hi] - total[lo:hi], count[lo:hi]) + np.arange(total[lo], total[hi])
        lo = hi


def likely_pairs(i: np.ndarray, j: np.ndarray, bands: np.ndarray, sizes: np.ndarray, band: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose posterior stays above the tolerance; band: where rows meet, -1 if not by a band. A pair that shares an
    earlier band is compared there."""
    small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
    keep = small >= threshold * large - 1e-9
    i, j = i[keep], j[keep]
    for k in range(int(band.max(initial=-1))):
        keep = (band[i] <= k) | (bands[i, k] != bands[j, k])
        i, j = i[keep], j[keep]
    values = bands.view(np.uint16)
    seen = np.zeros(len(i), np.int16)
    for at in range(0, values.shape[1], STEP):
        end = min(at + STEP, values.shape[1])
        seen = seen + (values[i, at:end] == values[j, at:end]).sum(1, dtype=np.int16)
        keep = seen >= least_matches(end, threshold, tolerance)
        i, j, seen = i[keep], j[keep], seen[keep]
    return i, j


def similar_pairs(i: np.ndarray, j: np.ndarray, sets: list[np.ndarray], starts: list[int], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose sets are as similar as the threshold, exactly; pairs are in the order of i."""
    common = np.zeros(len(i), np.int64)
    group = np.searchsorted(starts, i, "right")
    cuts = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), len(i)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        left, x = np.unique(i[lo:hi], return_inverse=True)
        right, y = np.unique(j[lo:hi], return_inverse=True)
        if hi - lo <= 4 * (len(left) + len(right)):
            common[lo:hi] = [len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i[lo:hi].tolist(), j[lo:hi].tolist(), strict=True)]
            continue
        for part in range(0, len(left), BLOCK):
            rows = (x >= part) & (x < part + BLOCK)
            common[lo:hi][rows] = _common(sets, left[part : part + BLOCK], right)[x[rows] - part, y[rows]]
    sizes = np.array([len(s) for s in sets])
    sure = common >= threshold * (sizes[i] + sizes[j] - common) - 1e-9
    return i[sure], j[sure]


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of all intersections of two blocks, by products of incidence matrices over slices of the shingles."""
    rows = np.concatenate([left, right])
    sizes = [len(sets[r]) for r in rows]
    vocabulary, index = np.unique(np.concatenate([sets[r] for r in rows]), return_inverse=True)
    at = np.repeat(np.arange(len(rows)), sizes)
    order = np.argsort(index, kind="stable")
    index, at = index[order], at[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, len(vocabulary), 2048):
        x, y = np.searchsorted(index, (lo, lo + 2048))
        block = np.zeros((len(rows), 2048), np.float32)
        block[at[x:y], index[x:y] - lo] = 1
        out += block[: len(left)] @ block[len(left) :].T
    return np.rint(out).astype(np.int64)


def star_forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the pairs: the rows that aren't the smallest of theirs, and the smallest."""
    low = np.arange(n)
    while True:
        least = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, low[i], least)
        np.minimum.at(new, low[j], least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    rows = np.flatnonzero(low != np.arange(n))
    return rows, low[rows]


GROUP = ["component", "band", "bucket", "low", "high"]


class _Block:
    """Rows of whole groups as arrays; repeated rows of an id in a group count once."""

    def __init__(self, table: pa.Table):
        ids = table.column("id").to_numpy()
        starts = group_starts(table, GROUP)
        new = np.concatenate(([True], ids[1:] != ids[:-1]))
        new[starts] = True
        self.starts = (np.cumsum(new) - 1)[starts].tolist()
        self.table = table.filter(pa.array(new)) if not new.all() else table
        self.ids = self.table.column("id").to_numpy()
        self.band, self.own, self.low, self.high, self.sizes = (self.table.column(c).to_numpy() for c in ("band", "block", "low", "high", "size"))
        lists = self.table.column("bands").combine_chunks()
        self.bands = (lists.flatten().to_numpy() if len(lists) else np.zeros(0, np.int64)).astype(np.int64).reshape(-1, BANDS).view(U64)

    def likely(self, threshold: float, tolerance: float) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Pairs that may be similar, and how many were compared for them."""
        for i, j in pair_chunks(self.starts, self.own, self.low, self.high):
            yield *likely_pairs(i, j, self.bands, self.sizes, self.band, threshold, tolerance), len(i)


SURVIVORS = "band long, bucket long, low long, high long, block long, id long, other long, compared long"


def _survivors_of(threshold: float, tolerance: float):
    """Who has a pair left in a block of a bucket: (the block, id); and (id, other) for the forest of these pairs; and the number of comparisons."""

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SURVIVORS.split(", ")]
        for table in whole_groups(batches, GROUP, 1 << 14):
            block = _Block(table)
            n, compared = len(block.ids), 0
            active, edges = np.zeros(n, bool), [np.zeros((2, 0), np.int64)]
            for i, j, c in block.likely(threshold, tolerance):
                compared += c
                active[i] = active[j] = True
                edges.append(np.stack(star_forest(i, j, n)))
            rows, lows = star_forest(*np.concatenate(edges, 1), n)
            at = np.flatnonzero(active)
            key = [block.table.column(c).to_numpy()[at] for c in ("band", "bucket", "low", "high", "block")]
            size = (len(at), len(rows), 1)
            none = lambda k: pa.nulls(k, pa.int64())
            columns = [pa.concat_arrays([pa.array(k), none(size[1] + 1)]) for k in key]
            columns += [pa.concat_arrays([pa.array(block.ids[at]), pa.array(block.ids[rows]), none(1)]), pa.concat_arrays([none(size[0]), pa.array(block.ids[lows]), none(1)]), pa.concat_arrays([none(size[0] + size[1]), pa.array([compared], pa.int64())])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return survivors


def _links_of(threshold: float, tolerance: float):
    """Verified links of blocks: (id, null, weight of links) and (id, other, null) for the forest."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, GROUP, 1024):
            block = _Block(table)
            n = len(block.ids)
            data, offsets = text_bytes(block.table.column("shingles"))
            sets = [data[a:b].view(U64) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            weights = block.table.column("copies").to_numpy()
            total, edges = np.zeros(n), [np.zeros((2, 0), np.int64)]
            for i, j, _ in block.likely(threshold, tolerance):
                i, j = similar_pairs(i, j, sets, block.starts, threshold)
                total += np.bincount(i, weights[j], n) + np.bincount(j, weights[i], n)
                edges.append(np.stack(star_forest(i, j, n)))
            rows, lows = star_forest(*np.concatenate(edges, 1), n)
            at = np.flatnonzero(total)
            none = lambda k: pa.nulls(k, pa.int64())
            columns = [pa.concat_arrays([pa.array(block.ids[at]), pa.array(block.ids[rows])]), pa.concat_arrays([none(len(at)), pa.array(block.ids[lows])]), pa.concat_arrays([pa.array(np.rint(total[at]).astype(np.int64)), none(len(rows))])]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "other", "links"])

    return links


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts' shingles as bytes, beside the other columns."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("body"))
        names = [n for n in batch.schema.names if n != "body"]
        for lo, hi in slabs(offsets):
            sets, ends = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            binary = pa.array([sets[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(lo, hi - lo) for n in names), binary], names=[*names, "shingles"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (a, b), a component being its smallest node.

    Alternates large-star and small-star rounds until no edge changes: a number of rounds that grows with
    the logarithm of the nodes. The minimum of a node's neighbours is aggregated, with partial minima in every
    task, before it is joined; what is joined is two ids a row, also for a node with very many edges.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())

    now = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    before = state(now)
    while before[0]:
        both = now.union(now.select("b", "a")).toDF("node", "other")
        low = both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("low", "node").alias("low"))
        large = both.where("other > node").join(low, "node").select(F.col("low").alias("a"), F.col("other").alias("b")).where("a <> b").distinct()
        # Each node now has few smaller neighbours: grouped by the larger end, no key is hot.
        low = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(low, "b").select(F.col("low").alias("a"), F.col("a").alias("b")).where("a <> b").union(low.select(F.col("low").alias("a"), "b"))
        now = materialize(small.distinct())
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select("a", "a").distinct())


MARK = ["print", "print2", "size"]


def _same_document(left: DataFrame, right: DataFrame) -> Column:
    return left["doc"].eqNullSafe(right["doc"]) & (left["mark"] == right["mark"])


def text_mark(text: Column) -> Column:
    """What tells the texts of one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def in_block_pairs(rows: DataFrame, keys: list[str], *carried: str) -> DataFrame:
    """Rows (keys, id, block, blocks, carried) dealt to each pair of blocks (low, high) of their keys that they take part in."""
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("with")
    dealt = rows.select(*keys, "id", "block", *carried, other)
    return dealt.select(*keys, "id", "block", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), *carried)


def sorted_groups(rows: DataFrame) -> DataFrame:
    """Rows with whole groups in one task, in the order that _Block needs."""
    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP, "block", "id")


def survivors(reps: DataFrame, *, threshold: float, tolerance: float) -> DataFrame:
    """Rows of SURVIVORS from representatives (rep, size, bands): pairs of all buckets compared, each in its first common band."""
    keyed = reps.select(F.col("rep").alias("id"), F.posexplode("bands").alias("band", "bucket"))
    counts = keyed.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    counts = materialize(counts.select("band", "bucket", F.ceil(F.col("n") / BLOCK).alias("blocks")))
    met = keyed.join(counts, ["band", "bucket"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    met = met.join(reps.select(F.col("rep").alias("id"), "size", "bands"), "id")
    dealt = in_block_pairs(met, ["band", "bucket"], "blocks", "size", "bands").drop("blocks")
    dealt = dealt.withColumn("component", F.lit(0).cast("long")).withColumn("band", F.col("band").cast("long"))
    return materialize(sorted_groups(dealt.select(*GROUP, "block", "id", "size", "bands")).mapInArrow(_survivors_of(threshold, tolerance), SURVIVORS))


def linked(docs: DataFrame, *, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per distinct document with words, (doc, mark): doc, mark, class_id, n_links, leads (see jaccard_groups)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), text_mark(F.col("text")).alias("mark"), F.col("text").alias("body"))
    features = materialize(rows.mapInArrow(_features, FEATURES))
    # Documents are numbered in ascending doc_id, null last; written, as a range partitioning made anew may number otherwise.
    order = [F.col("doc").asc_nulls_last(), F.col("mark")]
    known = features.select("doc", "mark", *MARK).distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    known = materialize(known.withColumn("id", F.monotonically_increasing_id()))
    reps = known.groupBy(*MARK).agg(F.min(F.struct("id", "doc", "mark")).alias("lead"), F.count("*").alias("copies"))
    reps = materialize(reps.select(F.col("lead.id").alias("rep"), "lead.doc", "lead.mark", "copies", *MARK))
    # repeated rows of a document have the same values
    values = features.join(reps.select("rep", "doc", "mark"), _same_document(features, reps)).select("rep", "size", "bands")
    values = materialize(values.dropDuplicates(["rep"]))

    left = survivors(values, threshold=threshold, tolerance=tolerance)
    parts = components(left.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "id")
    parts = materialize(parts.join(reps.select(F.col("rep").alias("id"), "doc", "mark", "copies", "size"), "id"))
    active = left.where("band IS NOT NULL").select("band", "bucket", "low", "high", "block", "id")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias("blocks")
    whole = parts.groupBy("component").agg(F.count("*").alias("n"), blocks)
    by_bucket = active.join(parts.select("id", "component"), "id").groupBy("component").agg(F.count("*").alias("sent"))
    # sets that the pairs of blocks send, and those that the buckets do
    way = whole.join(by_bucket, "component").select("component", "blocks", (F.col("blocks") * F.col("n") > F.col("sent")).alias("by_bucket"))
    way = materialize(way.withColumn("by_bucket", F.col("by_bucket") & (F.col("blocks") > 1)))
    placed = parts.join(way, "component").join(values.select(F.col("rep").alias("id"), "bands"), "id")
    sets = rows.join(placed, _same_document(rows, placed)).select("body", "id", "component", "copies", "size", "bands", "blocks", "by_bucket")
    sets = sets.mapInArrow(_shingles, "id long, component long, copies long, size long, bands array<long>, blocks long, by_bucket boolean, shingles binary")
    sets = materialize(sets)
    carried = ["size", "bands", "copies", "shingles"]
    blocked = in_block_pairs(sets.where("NOT by_bucket").withColumn("block", F.pmod(F.xxhash64("id"), "blocks")), ["component"], "blocks", *carried).drop("blocks")
    blocked = blocked.withColumn("band", F.lit(-1).cast("long")).withColumn("bucket", F.lit(0).cast("long"))
    bucketed = sets.where("by_bucket").select("id", "component", *carried).join(active, "id")
    dealt = sorted_groups(blocked.select(*GROUP, "block", "id", *carried).unionByName(bucketed.select(*GROUP, "block", "id", *carried)))
    found = materialize(dealt.mapInArrow(_links_of(threshold, tolerance), "id long, other long, links long"))

    links = found.where("other IS NULL").groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
    groups = groups.join(reps.select(F.col("rep").alias("component"), F.col("doc").alias("class_id")), "component").select(F.col("node").alias("rep"), "component", "class_id")
    told = reps.join(links.withColumnRenamed("id", "rep"), "rep", "left").join(groups, "rep", "left")
    alone = F.col("component").isNull()
    told = told.select("rep", *MARK, F.when(alone, F.col("rep")).otherwise(F.col("component")).alias("lead"), F.when(alone, F.col("doc")).otherwise(F.col("class_id")).alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    return known.join(materialize(told), MARK).select("doc", "mark", "class_id", "n_links", (F.col("id") == F.col("lead")).alias("leads"))


def jaccard_groups(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, class_id, n_links.

    Documents link if the Jaccard similarity of their sets of five-word shingles is at least the
    threshold; class_id is the smallest doc_id that links lead to, n_links the number of other documents
    that the document itself links to, copies included. Texts without words link to nothing, not to each
    other either. Repeated rows are one document; different texts of one doc_id are documents of
    their own, with a row each. A null doc_id comes after all others: it is a class_id only where no other
    document is in the class. Only doc_id and text are read.
    """
    told = linked(docs, **options)
    every = docs.select(F.col("doc_id").cast("long").alias("doc"), text_mark(F.col("text")).alias("mark")).distinct()
    full = every.join(told, _same_document(every, told), "left").select(every["doc"].alias("doc_id"), F.coalesce("class_id", every["doc"]).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return full


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The document with the smallest id of each group, with all rows that repeat it; documents without words stay."""
    told = linked(docs, **options)
    gone = told.where("NOT leads").select("doc", "mark")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc"), text_mark(F.col("text")).alias("mark"))
    return rows.join(gone, _same_document(rows, gone), "left_anti").select("row.*")
