"""Indexes after batches of changes equal those of a full rebuild."""

import pytest
from pyspark.sql import functions as F

from folioscope.operators.upkeep import ChunkIndexes, hash_vectors

STATES = [
    [("1", "the cat sat"), ("2", "a dog ran"), ("3", "结构 构件"), ("4", None), ("5", "cat cat dog")],
    [("1", "the cat sat"), ("2", "a dog sat"), ("4", "now with words"), ("5", "cat cat dog"), ("6", "a new cat")],
    [("6", "a new cat"), ("7", ""), ("1", "the cat")],
]


def made(spark, path):
    return ChunkIndexes(spark, str(path), targets=lambda rows: rows.where("text <> ''").select("chunk_id", F.upper("text").alias("snippet")))


def chunks(spark, state):
    return spark.createDataFrame(state, "chunk_id string, text string")


def content(indexes):
    postings = indexes.text.store.read("postings").select("token", "key", "tf", "dl")
    lengths = indexes.text.store.read("lengths")
    vectors = indexes.vectors.store.read("vectors").select("key", F.transform("vector", lambda x: F.round(x, 9)))
    facts = indexes.text.store.manifest().facts()
    tables = (postings, lengths, vectors, indexes.targets.read("targets"), indexes.hashes.read("hashes"))
    return (facts, *(sorted(map(str, df.collect())) for df in tables))


def test_batches_equal_a_rebuild(spark, tmp_path):
    kept = made(spark, tmp_path / "kept")
    counts = [kept.apply(f"batch {i}", chunks(spark, state)) for i, state in enumerate(STATES)]
    assert counts == [{"added": 5}, {"added": 1, "changed": 2, "removed": 1}, {"added": 1, "changed": 1, "removed": 3}]
    rebuilt = made(spark, tmp_path / "rebuilt")
    rebuilt.apply("all", chunks(spark, STATES[-1]))
    assert content(kept) == content(rebuilt)


def test_a_batch_that_failed_on_the_way_is_run_again(spark, tmp_path, monkeypatch):
    kept = made(spark, tmp_path / "kept")
    kept.apply("first", chunks(spark, STATES[0]))
    with monkeypatch.context() as m:
        m.setattr(kept.vectors, "replace", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            kept.apply("second", chunks(spark, STATES[1]))
    assert kept.apply("second", chunks(spark, STATES[1])) == {"added": 1, "changed": 2, "removed": 1}
    rebuilt = made(spark, tmp_path / "rebuilt")
    rebuilt.apply("all", chunks(spark, STATES[1]))
    assert content(kept) == content(rebuilt)


def test_hash_vectors_are_units(spark):
    got = {r["key"]: r["vector"] for r in hash_vectors(chunks(spark, STATES[0]), "chunk_id", "text").collect()}
    assert set(got) == {"1", "2", "3", "5"} and all(len(v) == 64 and abs(sum(x * x for x in v) - 1) < 1e-9 for v in got.values())
