"""Benchmark decontamination by Wu-Manber search over words.

Every window of ten item words (or a whole shorter item) is a pattern whose symbols are words. A
shift table over blocks of two words says how far a window may slide; where it says zero, the last
block picks the bucket of patterns to compare. Texts are searched in many segments side by side, so
each step is a few numpy calls.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import U64, Words, free_name, materialize, slabs, small_batches, text_bytes

WINDOW = 10
#: Item text, in bytes, that one search holds in memory; more items take more searches over the texts.
BLOCK_BYTES = 8 << 20
#: Window ends that one search lane covers.
LANE = 512
#: Letters of a word that are compared for all occurrences at once; longer words are compared one by one.
MOST_STEPS = 64

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
HIT = "struct<n_words:bigint,n_hit:bigint,spans:array<bigint>,items:array<string>>"
HIT_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def item_words(text: str | None) -> list[bytes]:
    return WORD.findall(bytes(text or "", "utf-8").lower())


class Patterns:
    """Windows of one length: shift table, suffix buckets, and the words to compare."""

    def __init__(self, length: int, windows: list[tuple[bytes, ...]]):
        self.length, self.block = length, min(2, length)
        flat = [w for window in windows for w in window]
        data = np.frombuffer(b" ".join(flat), np.uint8)
        own = Words(data, np.array([0, len(data)]))
        self.codes, self.starts, self.ends = own.codes, own.starts.reshape(-1, length), own.ends.reshape(-1, length)
        self.words = own.hashes.reshape(len(windows), length)
        self.bits = max(12, int(np.ceil(np.log2(8 * len(windows) * length))))
        self.shift = np.full(1 << self.bits, length - self.block + 1, np.int64)
        for end in range(self.block - 1, length):
            slots = self.slot(self.blocks(self.words, end))
            np.minimum.at(self.shift, slots, length - 1 - end)
        last = self.blocks(self.words, length - 1)
        self.order = np.argsort(last, kind="stable")
        self.suffixes = last[self.order]

    def blocks(self, words: np.ndarray, end) -> np.ndarray:
        """Value of the block of words that ends at a position of the last axis."""
        last = words[..., end]
        return last if self.block == 1 else last ^ (words[..., end - 1] * U64(0xA24BAED4963EE407))

    def slot(self, blocks: np.ndarray) -> np.ndarray:
        return (blocks * U64(0x9FB21C651E98DF25) >> U64(64 - self.bits)).astype(np.int64)

    def search(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """First word and pattern of each occurrence."""
        hashes, n = words.hashes, len(words.hashes)
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(self.length - 1, n, LANE)
        stop = np.minimum(at + LANE, n)
        found = []
        while len(at):
            step = self.shift[self.slot(self.blocks(hashes, at))]
            if (hit := at[step == 0]).size:
                found.append(hit)
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not found:
            return none
        ends = np.concatenate(found)
        last = self.blocks(hashes, ends)
        lo, hi = np.searchsorted(self.suffixes, last), np.searchsorted(self.suffixes, last, "right")
        counts = hi - lo
        ends = np.repeat(ends, counts)
        which = self.order[np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo, counts)]
        first = ends - self.length + 1
        same = np.searchsorted(words.first, first, "right") == np.searchsorted(words.first, ends, "right")
        for k in range(self.length):
            same &= hashes[first + k] == self.words[which, k]
        first, which = first[same], which[same]
        sure = self.equal(words, first, which)
        return first[sure], which[sure]

    def equal(self, words: Words, first: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Direct comparison of the documents' words with the patterns', letter by letter, for all occurrences at once."""
        sure = np.ones(len(first), bool)
        for k in range(self.length):
            begin, size = words.starts[first + k], words.ends[first + k] - words.starts[first + k]
            other = self.starts[which, k]
            sure &= size == self.ends[which, k] - other
            live = np.flatnonzero(sure)
            at = 0
            while len(live) and at < MOST_STEPS:
                live = live[size[live] > at]
                sure[live] &= words.codes[begin[live] + at] == self.codes[other[live] + at]
                live = live[sure[live]]
                at += 1
            for i in live[size[live] > at]:  # the rest of words that are longer than that
                sure[i] = (words.codes[begin[i] : begin[i] + size[i]] == self.codes[other[i] : other[i] + size[i]]).all()
        return sure


class Block:
    """Patterns of some items, by length, and the items of each pattern."""

    def __init__(self, items: list[tuple[str | None, str | None]]):
        owners: dict[tuple[bytes, ...], set[str | None]] = defaultdict(set)
        for name, text in items:
            words = item_words(text)
            for i in range(max(len(words) - WINDOW + 1, min(1, len(words)))):
                owners[tuple(words[i : i + WINDOW])].add(name)
        by_length: dict[int, list[tuple[bytes, ...]]] = defaultdict(list)
        for window in sorted(owners):
            by_length[len(window)].append(window)
        self.sets = [(Patterns(n, w), [sorted(x for x in owners[k] if x is not None) for k in w]) for n, w in sorted(by_length.items())]

    def scan(self, texts: pa.Array) -> pa.Array:
        """What each text shares with the items."""
        data, offsets = text_bytes(texts)
        n_words, n_hit, spans_of, items_of = [], [], [], []
        for lo, hi in slabs(offsets):
            words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1])
            edges = np.zeros(len(words.hashes) + 1, np.int64)
            named: dict[int, set[str]] = defaultdict(set)
            for patterns, owners in self.sets:
                first, which = patterns.search(words)
                np.add.at(edges, first, 1)
                np.add.at(edges, first + patterns.length, -1)
                row = np.searchsorted(words.first, first, "right") - 1
                for r, p in zip(*np.divmod(np.unique(row * len(owners) + which), len(owners)), strict=True):
                    named[int(r)].update(owners[p])
            covered = np.cumsum(edges)[:-1] > 0
            total = np.concatenate(([0], np.cumsum(covered)))
            n_words += np.diff(words.first).tolist()
            n_hit += (total[words.first[1:]] - total[words.first[:-1]]).tolist()
            for r in range(hi - lo):
                spans: list[int] = []
                if n_hit[lo + r]:
                    own = covered[words.first[r] : words.first[r + 1]].astype(np.int8)
                    spans = np.flatnonzero(np.diff(own, prepend=0, append=0)).tolist()
                spans_of.append(spans)
                items_of.append(sorted(named[r]) if r in named else [])
        return pa.StructArray.from_arrays(
            [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans_of, pa.list_(pa.int64())), pa.array(items_of, pa.list_(pa.string()))], fields=list(HIT_ARROW)
        )


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[Block]:
    """Items in blocks of about so many bytes; one block at a time passes through the driver."""
    items = benchmark.select(F.col(item_id).cast("string").alias("name"), F.col(text).alias("body"))
    size = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("name", "body"), F.lit(n)) == k) if n > 1 else items
        yield Block([tuple(r) for r in part.collect()])


def _search(spark: SparkSession, block: Block):
    held = spark.sparkContext.broadcast(block)

    def search(texts: pa.Array) -> pa.Array:
        return held.value.scan(texts)

    return F.arrow_udf(search, HIT)


#: Maximal ranges of a flat sorted list of (from, to) pairs.
UNITED = """aggregate(array_sort(pairs), cast(array() as array<struct<a:bigint,b:bigint>>), (done, x) ->
    CASE WHEN size(done) > 0 AND x.a <= element_at(done, -1).b
         THEN concat(slice(done, 1, size(done) - 1), array(named_struct('a', element_at(done, -1).a, 'b', greatest(element_at(done, -1).b, x.b))))
         ELSE concat(done, array(x)) END)"""


def _united(found: list[DataFrame]) -> DataFrame:
    """One row (mark, n_words, n_hit, spans, items) per text of what several searches found in it."""
    rows = reduce(DataFrame.unionByName, found)
    pairs = F.transform(F.sequence(F.lit(0), (F.size("hit.spans") / 2).cast("int") - 1), lambda i: F.struct(F.get("hit.spans", 2 * i).alias("a"), F.get("hit.spans", 2 * i + 1).alias("b")))
    one = rows.groupBy("mark").agg(F.max("hit.n_words").alias("n_words"), F.flatten(F.collect_list(pairs)).alias("pairs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit.items")))).alias("items"))
    one = one.withColumn("united", F.expr(UNITED))
    n_hit = F.aggregate("united", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    return one.select("mark", F.struct("n_words", n_hit.alias("n_hit"), F.flatten(F.transform("united", lambda x: F.array(x["a"], x["b"]))).alias("spans"), "items").cast(HIT).alias("hit"))


def contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, Column]:
    """Documents with what they share with benchmark items, as (frame, struct column of it).

    The struct has n_words, n_hit (words inside any occurrence of a window), spans (flat list of
    maximal hit ranges of word positions, [from, to)) and items (sorted ids with an occurring window).
    Null and empty texts have no words. Repeated rows and rows of any other columns pass unchanged.
    Items without words match nothing; items with a null id count for hits, but aren't listed; an
    empty benchmark leaves all documents clean. Items of more than block_bytes are searched in several
    blocks: each search reads the distinct texts alone and keeps those with hits, which are joined to the documents at last.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    name = free_name("hit", docs.columns)
    blocks = _blocks(benchmark, item_id, item_text, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return docs.select("*", _search(spark, first)(F.col(text)).alias(name)), F.col(name)
    mark = F.md5(F.coalesce(F.col(text).cast("binary"), F.lit(b"")))
    texts = docs.select(mark.alias("mark"), F.col(text).alias("body"))
    found = []
    for block in chain((first, second), blocks):
        hits = texts.select("mark", _search(spark, block)("body").alias("hit")).where("hit.n_hit > 0")
        found.append(materialize(hits.groupBy("mark").agg(F.any_value("hit").alias("hit"))))
    rows = docs.select(F.struct(*docs.columns).alias("row"), mark.alias("mark")).join(materialize(_united(found)), "mark", "left")
    own = F.struct(_count_words()(F.col("row")[text]).alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<bigint>").alias("spans"), F.array().cast("array<string>").alias("items"))
    return rows.select("row.*", F.coalesce("hit", own).alias(name)), F.col(name)


def _count_words():
    def count(texts: pa.Array) -> pa.Array:
        data, offsets = text_bytes(texts)
        return pa.array([n for lo, hi in slabs(offsets) for n in np.diff(Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1]).first).tolist()], pa.int64())

    return F.arrow_udf(count, "long")


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (see contamination)."""
    found, hit = contamination(docs.select("doc_id", "text"), benchmark, **options)
    return found.select(
        "doc_id",
        hit["n_words"].alias("n_words"),
        hit["n_hit"].alias("n_hit"),
        F.size(hit["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(hit["items"], ","), 256).alias("items_sha256"),
        (hit["n_hit"] > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no benchmark window occurs; columns stay as they are."""
    found, hit = contamination(docs, benchmark, **options)
    return found.where(hit["n_hit"] == 0).select(*docs.columns)
