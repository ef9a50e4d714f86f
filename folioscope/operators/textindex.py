"""A kept inverted index: posting lists in buckets of tokens, replaced by document, read by the buckets of a question's tokens.

Tables of the store: `postings` (bucket, token, key, tf, dl), partitioned by bucket and sorted by token, so that a question reads
the folders of its tokens' buckets and within them the row groups that may hold them; `lengths` (key, dl), one row a text. Number and total
length of the texts are sums in the manifest, so no question scans the corpus for them.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import bigrams
from folioscope.operators.search import index_runs, index_tokens, run_pairs
from folioscope.session import written
from folioscope.sources.segments import Segments

BUCKETS = 64
#: Postings that a task sorts and writes at most, about: they fit its memory, so that nothing is spilled however large the corpus is.
TASK_POSTINGS = 1_000_000


def bucket_of(token: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.crc32(token.cast("binary")), F.lit(buckets)).cast("int")


def _counted(batches: Iterable[pa.RecordBatch], pieces: Callable[[str], list[str]] | None = None) -> Iterator[pa.RecordBatch]:
    """Texts (key, tokens) as (key, dl, counts): the distinct tokens of each with how often it has them, sorted out for all texts of a batch at once.

    With `pieces` the tokens of a text are the pieces of what is given: each distinct one of a batch is cut once, and how often a text has it is counted before.
    """
    for batch in batches:
        key, tokens = batch.columns
        dl = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
        terms = tokens.flatten().dictionary_encode()
        names, kinds = terms.dictionary, max(1, len(terms.dictionary))
        # one number for each (text, term)
        seen, n = np.unique(np.repeat(np.arange(len(dl)), dl) * kinds + terms.indices.to_numpy().astype(np.int64), return_counts=True)
        if pieces is not None:
            cut = [pieces(x) for x in names.to_pylist()]
            place: dict[str, int] = {}
            ids = np.array([place.setdefault(p, len(place)) for ps in cut for p in ps], np.int64)
            sizes = np.array([len(ps) for ps in cut], np.int64)
            text, term = np.divmod(seen, kinds)
            each = sizes[term] if len(sizes) else term
            starts = np.repeat((np.cumsum(sizes) - sizes)[term] if len(sizes) else term, each)
            at = starts + np.arange(len(starts)) - np.repeat(np.cumsum(each) - each, each)
            dl = np.bincount(text, n * each, minlength=len(dl)).astype(np.int64)
            names, kinds = pa.array(list(place), pa.string()), max(1, len(place))
            seen, back = np.unique(np.repeat(text, each) * kinds + ids[at], return_inverse=True)
            n = np.bincount(back, np.repeat(n, each), minlength=len(seen)).astype(np.int64)
        offsets = np.zeros(len(dl) + 1, np.int32)
        np.cumsum(np.bincount(seen // kinds, minlength=len(dl)), out=offsets[1:])
        counts = pa.StructArray.from_arrays([names.take(pa.array(seen % kinds)), pa.array(n.astype(np.int64))], names=["term", "n"])
        yield pa.RecordBatch.from_arrays([key, pa.array(dl), pa.ListArray.from_arrays(pa.array(offsets), counts)], names=["key", "dl", "counts"])


class TextIndex:
    """Full-text index of texts with unique keys that aren't null; texts without tokens count in the statistics alone, null texts are empty.

    tokens: the tokens of a text as a column; all batches of an index have to be made with the same.
    """

    def __init__(self, spark: SparkSession, path: str, *, buckets: int = BUCKETS, tokens: Callable[[Column], Column] = index_tokens):
        self.store = Segments(spark, path, "key", partitions={"postings": ["bucket"]})
        self.spark, self.buckets, self.tokens = spark, buckets, tokens

    def _postings(self, rows: DataFrame, n: int) -> DataFrame:
        """The n postings, sorted, in tasks of at most about TASK_POSTINGS: a bucket of more is dealt by the keys, so a frequent token is spread too."""
        entries = rows.select("key", "dl", F.explode("counts").alias("c"))
        entries = entries.select(bucket_of(F.col("c.term"), self.buckets).alias("bucket"), F.col("c.term").alias("token"), "key", F.col("c.n").alias("tf"), "dl")
        tasks = -(-n // TASK_POSTINGS)
        pieces = F.pmod(F.xxhash64("key"), F.lit(-(-tasks // self.buckets) or 1))
        usual = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = entries.repartition(tasks, "bucket", pieces) if tasks > usual else entries.repartition("bucket", pieces)
        return dealt.sortWithinPartitions("bucket", "token")

    def replace(self, batch: str, docs: DataFrame, key: str, text: str, *, removed: DataFrame | None = None) -> bool:
        """Indexes texts in place of those of the same keys, and drops the keys in `removed`; false if the batch was applied before.

        Cost is that of the texts given: only their postings are written, in the buckets of their tokens.
        """
        at = self.store.manifest()
        if batch in at.batches:
            return False
        # pairs are many times their runs, so runs are sent and cut there
        cut, pieces = (index_runs, run_pairs) if self.tokens is index_tokens else (self.tokens, None)
        told = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), cut(F.col(text)).alias("tokens"))
        # terms are counted within the row of their text, once: all that follows reads the counts
        rows = written(told.mapInArrow(partial(_counted, pieces=pieces), "key string, dl long, counts array<struct<term:string,n:long>>"))
        keys = rows.select("key")
        if removed is not None:
            keys = keys.unionByName(removed.select(F.col(removed.columns[0]).cast("string").alias("key")))
        added = rows.agg(F.count("*"), F.sum("dl"), F.sum(F.size("counts"))).first()
        facts = {"n": added[0], "length": added[1] or 0}
        gone = None
        if at.segments:
            gone = keys.distinct()
            lost = self.store.read("lengths", at=at).join(gone, "key", "left_semi").agg(F.count("*"), F.sum("dl")).first()
            facts = {"n": added[0] - lost[0], "length": facts["length"] - (lost[1] or 0)}
        tables = {"postings": self._postings(rows, added[2] or 0), "lengths": rows.select("key", "dl")}
        return self.store.commit(batch, tables, gone=gone, facts=facts)

    def hits(self, tokens: Sequence[str]) -> DataFrame:
        """Postings (token, key, tf, dl) of the tokens, from their buckets alone."""
        wanted = sorted(set(tokens))
        rows = self.store.read("postings")
        if not wanted:
            return rows.limit(0).drop("bucket")
        # the same buckets as the column gives: crc32 of the UTF-8 bytes
        return rows.where(F.col("bucket").isin(*{crc32(t.encode()) % self.buckets for t in wanted}) & F.col("token").isin(*wanted)).drop("bucket")

    def bm25(self, query: Sequence[str], *, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(key, score) of the texts with any query token; a token that is asked for twice counts twice."""
        facts = self.store.manifest().facts()
        n, average = facts.get("n", 0), facts.get("length", 0) / max(1, facts.get("n", 0)) or 1.0
        tf = self.hits(query)
        df = tf.groupBy("token").agg(F.count("*").alias("df"))  # at most one row per query token
        times = F.create_map(*(F.lit(x) for t in sorted(set(query)) for x in (t, list(query).count(t)))) if query else F.lit(None).cast("map<string,int>")
        idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        part = F.element_at(times, F.col("token")) * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / average))
        return tf.join(F.broadcast(df), "token").groupBy("key").agg(F.sum(part).alias("score"))

    def search(self, query: Sequence[str], *, top: int = 20) -> DataFrame:
        """The best texts by BM25 (k1 1.2, b 0.75)."""
        return self.bm25(list(dict.fromkeys(query))).orderBy(F.desc("score"), "key").limit(top)


class GramIndex:
    """TF-IDF vectors of character pairs as postings and the norms of all texts, so that a question reads the pairs that it has.

    Frequencies count the question as one more text, which changes the weight of every pair a little. A norm is therefore kept in three sums
    over a text's pairs, of tf, tf * ln(df) and tf * ln(df)^2 (each with tf squared), from which the norm for any number of texts follows; for the pairs
    of the question, whose df is one more, the postings correct it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.index = TextIndex(spark, f"{path}/pairs", tokens=lambda text: bigrams(F.coalesce(text, F.lit(""))))
        self.path, self.spark = path, spark

    def load(self, docs: DataFrame, key: str, text: str) -> None:
        """Indexes all texts, in place of those that were there; one shuffle of the distinct pairs of each text, once."""
        self.index.replace(uuid.uuid4().hex, docs, key, text)
        entries = self.index.store.read("postings").select("token", "key", (F.col("tf") / F.col("dl")).alias("tf"))
        logs = entries.groupBy("token").agg(F.log(F.count("*").cast("double")).alias("ldf"))
        square = F.col("tf") ** 2
        entries.join(logs, "token").groupBy("key").agg(F.sum(square).alias("a"), F.sum(square * F.col("ldf")).alias("b"), F.sum(square * F.col("ldf") ** 2).alias("c")).write.mode("overwrite").parquet(f"{self.path}/norms")

    def recall(self, query: str, *, top: int = 5, least: float = 0.02) -> DataFrame:
        """(key, score): the texts of the highest cosine to the question, if it is at least `least`."""
        grams = [query[i : i + 2] for i in range(len(query) - 1)]
        if not grams:
            return self.spark.createDataFrame([], "key string, score double")
        n = self.index.store.manifest().facts().get("n", 0) + 1
        all_ = F.lit(math.log(n))
        asked = self.spark.createDataFrame([(g, grams.count(g) / len(grams)) for g in sorted(set(grams))], "token string, query_tf double")
        hits = self.index.hits(grams).select("token", "key", (F.col("tf") / F.col("dl")).alias("tf"))
        df = F.broadcast(asked).join(hits.groupBy("token").agg(F.count("*").alias("df")), "token", "left").select("token", "query_tf", F.coalesce("df", F.lit(0)).alias("df"))  # one row a pair of the question
        weighed = df.select("token", "query_tf", (all_ - F.log(F.col("df") + 1.0)).alias("idf"), (all_ - F.log(F.greatest("df", F.lit(1)).cast("double"))).alias("kept_idf"))
        norm = weighed.agg(F.sqrt(F.sum((F.col("query_tf") * F.col("idf")) ** 2)).alias("norm"))
        own = F.col("tf") * F.col("idf")
        dots = hits.join(F.broadcast(weighed), "token").groupBy("key").agg(F.sum(own * F.col("query_tf") * F.col("idf")).alias("dot"), F.sum(own**2 - (F.col("tf") * F.col("kept_idf")) ** 2).alias("more"))
        norms = self.spark.read.schema("key string, a double, b double, c double").parquet(f"{self.path}/norms")
        size = F.sqrt(F.greatest(F.col("a") * all_ * all_ - 2 * F.col("b") * all_ + F.col("c") + F.col("more"), F.lit(0.0)))
        scored = dots.join(norms, "key").join(F.broadcast(norm)).select("key", F.when((size > 0) & (F.col("norm") > 0), F.col("dot") / (size * F.col("norm"))).otherwise(0.0).alias("score"))
        return scored.where(F.col("score") >= least).orderBy(F.desc("score"), "key").limit(top)
