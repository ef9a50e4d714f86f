"""Indexes kept up to date by change sets: of a new state of the chunks, only what differs from the last one is indexed."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import word_tokens
from folioscope.operators.textindex import TextIndex
from folioscope.operators.vectorindex import VectorIndex
from folioscope.session import written
from folioscope.sources.segments import Segments

DIMENSION = 64


def hash_vectors(chunks: DataFrame, key: str, text: str, *, dimension: int = DIMENSION) -> DataFrame:
    """(key, vector) of hashed words, as hash_embedding has them; chunks without words have none. Each row is one chunk, so nothing is shuffled."""

    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, words = batch.columns
            rows = np.repeat(np.arange(len(keys)), pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64))
            terms = words.flatten().dictionary_encode()
            digests = [hashlib.md5(t.encode()).digest() for t in terms.dictionary.to_pylist()]
            buckets = np.array([int.from_bytes(d[:4], "big") % dimension for d in digests], np.int64)
            signs = np.array([1.0 if d[4] % 2 == 0 else -1.0 for d in digests])
            at = terms.indices.to_numpy()
            sums = np.bincount(rows * dimension + buckets[at], weights=signs[at], minlength=len(keys) * dimension).reshape(len(keys), dimension)
            norms = np.sqrt((sums**2).sum(axis=1))
            some = norms > 0
            values = (sums[some] / norms[some, None]).ravel()
            offsets = np.arange(some.sum() + 1, dtype=np.int32) * dimension
            yield pa.RecordBatch.from_arrays([keys.filter(pa.array(some)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))], names=["key", "vector"])

    kind = chunks.schema[key].dataType.simpleString()
    return chunks.select(F.col(key).alias("key"), word_tokens(F.col(text)).alias("words")).mapInArrow(vectors, f"key {kind}, vector array<double>")


class ChunkIndexes:
    """Postings, vectors and citation targets of chunks (chunk_id, text), and the hash of each chunk that they were made of.

    A batch is a whole state of the chunks under a name. Its change set is worked out against the kept hashes, handed to each
    index under the batch's name, and the hashes are committed last. Each index takes a batch once, so a batch that failed on the way is run again with
    the same chunks: the change set is the same, and what has it already leaves it out. Ids are unique and not null.
    """

    def __init__(self, spark: SparkSession, path: str, *, targets: Callable[[DataFrame], DataFrame]):
        self.hashes = Segments(spark, f"{path}/hashes", "chunk_id")
        self.text = TextIndex(spark, f"{path}/text")
        self.vectors = VectorIndex(spark, f"{path}/vectors")
        self.targets = Segments(spark, f"{path}/targets", "chunk_id")
        self._make_targets = targets

    def changes(self, chunks: DataFrame) -> DataFrame:
        """(chunk_id, change, hash): added, changed and removed chunks; those with the same text are left out."""
        new = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
        if not self.hashes.manifest().segments:
            return new.select("chunk_id", F.lit("added").alias("change"), "hash")
        old = self.hashes.read("hashes").withColumnRenamed("hash", "_old")
        kind = F.when(F.col("_old").isNull(), "added").when(F.col("hash").isNull(), "removed").when(F.col("_old") != F.col("hash"), "changed")
        return new.join(old, "chunk_id", "full_outer").select("chunk_id", kind.alias("change"), "hash").where("change IS NOT NULL")

    def apply(self, batch: str, chunks: DataFrame) -> dict[str, int]:
        """Brings all indexes to the given state of the chunks; the number of chunks of each change."""
        found = written(self.changes(chunks))
        fresh = written(chunks.withColumn("chunk_id", F.col("chunk_id").cast("string")).join(found.where("change <> 'removed'").select("chunk_id"), "chunk_id", "left_semi"))
        removed = found.where("change = 'removed'").select("chunk_id")
        self.text.replace(batch, fresh, "chunk_id", "text", removed=removed)
        vectors = written(hash_vectors(fresh, "chunk_id", "text"))
        if self.vectors.model is None:
            self.vectors.fit(vectors, "key", "vector")
        self.vectors.replace(batch, vectors, "key", "vector", removed=found.where("change <> 'added'").select("chunk_id"))
        self.targets.commit(batch, {"targets": self._make_targets(fresh)}, gone=found.where("change <> 'added'").select("chunk_id"))
        self.hashes.commit(batch, {"hashes": found.where("change <> 'removed'").select("chunk_id", "hash")}, gone=found.where("change <> 'added'").select("chunk_id"))
        return {r["change"]: r["count"] for r in found.groupBy("change").count().collect()}
