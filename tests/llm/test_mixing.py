from collections import Counter

from folioscope.llm.mixing import mix, mix_report, numbered, source_targets


def test_targets_fill_up_to_the_cap(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 500), ("c", 300), ("d", 0), (None, 90), ("a", 5)], "source string, size long")
    got = {r["source"]: (r["source_size"], r["target"]) for r in source_targets(sizes).collect()}
    weights, sums = {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}, {"a": 15, "b": 500, "c": 300, "d": 0, None: 90}
    left, capped = dict(weights), {}
    while True:
        level = (sum(sums.values()) - sum(capped.values())) / sum(left.values())
        above = [s for s in left if weights[s] * level > 3 * sums[s]]
        if not above:
            break
        for s in above:
            capped[s] = 3 * sums[s]
            del left[s]
    for s in sums:
        assert got[s][0] == sums[s]
        assert abs(got[s][1] - capped.get(s, weights[s] * level)) < 1e-6


def test_odd_rows(spark, documents, odd_rows):
    docs = documents(odd_rows)
    report = mix_report(docs).collect()
    assert len(report) == len(odd_rows)
    assert {r["doc_id"]: r["size"] for r in report if r["doc_id"] in (3, 4, 5, 7)} == {3: 0, 4: 0, 5: 0, 7: 60_000}
    assert all(r["taken"] <= 3 * r["size"] for r in report)
    assert sorted(map(tuple, report), key=str) == sorted(map(tuple, mix_report(docs.repartition(3)).collect()), key=str)
    out = mix(docs)
    assert out.columns == [*docs.columns, "copy_"]
    times = Counter(r["doc_id"] for r in out.collect())
    assert {k: v for k, v in times.items() if k == 7} == {r["doc_id"]: r["taken"] // r["size"] for r in report if r["doc_id"] == 7}


def test_empty_and_wordless_tables(spark, documents):
    assert mix_report(documents([])).count() == 0
    assert [tuple(r) for r in mix_report(documents([(1, None)])).collect()] == [(1, 0, 0, 0.0, 0)]


def test_numbered(spark):
    from pyspark.sql import functions as F

    got = numbered(spark.range(1000).repartition(7), F.col("id").desc()).collect()
    assert all(r["number"] == 999 - r["id"] for r in got)


def test_names_that_differ_in_capitals(spark):
    from folioscope.llm.mixing import mix

    docs = spark.createDataFrame([(1, "some words", "a", "x")], "doc_id long, text string, source string, COPY string")
    out = mix(docs)
    assert out.columns == ["doc_id", "text", "source", "COPY", "copy_"] and out.collect()[0]["copy_"] == 1
