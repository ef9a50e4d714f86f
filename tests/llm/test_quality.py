import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from folioscope.llm.queries import QUERIES
from folioscope.llm.quality import STATISTICS, fit_quality, fit_rules, quality_scores, rule_values, text_statistics


def data(n=400):
    r = np.random.default_rng(1)
    words = ["alpha", "beta", "gamma", "delta", "house", "tree", "river", "stone"]
    rows = []
    for i in range(n):
        good = i % 3 > 0
        text = " ".join(r.choice(words, 30)) + "."
        rows.append((i, text if good else text.replace("a", "!!").upper(), int(good)))
    return rows


def test_learns_and_scores_held_out(spark):
    rows = data()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 4 < 3], "doc_id long, quality int")
    model = fit_quality(docs, labels)
    assert 0 < len(model.rules) < 100 and model.describe()
    got = {r["doc_id"]: r for r in quality_scores(docs, model).collect()}
    held = [r for r in rows if r[0] % 4 == 3]
    assert sum(got[i]["predicted"] == y for i, _, y in held) >= 0.98 * len(held)


def test_compiled_rules_equal_numpy(spark):
    rows = data()
    texts = [t for _, t, _ in rows]
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    x = text_statistics(np.frombuffer("".join(texts).encode(), np.uint8), offsets)
    model = fit_rules(x, np.array([y for *_, y in rows]))
    want = 1 / (1 + np.exp(-(rule_values(x, model.rules) @ np.array(model.weights) + model.intercept)))
    got = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, s array<double>").select("i", model.column(F.col("s")).alias("p")).orderBy("i").collect()
    assert np.allclose([r["p"] for r in got], want)


def test_odd_rows(spark, documents, odd_rows):
    docs = documents(odd_rows)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (99, 1), (7, 0), (6, 1)], "doc_id long, quality int")
    got = quality_scores(docs, fit_quality(docs, labels)).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)


def test_empty_tables(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_scores(documents([]), fit_quality(documents([]), labels)).count() == 0
    assert [r["score"] for r in quality_scores(documents([(1, "x")]), fit_quality(documents([]), labels)).collect()] == [0.5]


def test_statistics_are_finite():
    raw = "".encode() + b"A\n\nb!! 9"
    x = text_statistics(np.frombuffer(raw, np.uint8), np.array([0, 0, 1, len(raw)]))
    assert x.shape == (3, len(STATISTICS)) and np.isfinite(x).all() and not x[0].any()


# ---------------------------------------------------------------- the whole query


def plain_statistics(text):
    """STATISTICS of one text, written out."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(STATISTICS)
    words = [w for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", raw)]
    low = [w.lower() for w in words]  # of bytes: A-Z alone
    some, n = max(len(words), 1), len(raw)
    share = lambda keep: sum(map(keep, raw)) / n
    mark = lambda b: 33 <= b < 127 and not chr(b).isalnum()
    spans = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw)]
    lines = [x for x in raw.split(b"\n") if x]
    times = Counter(low)
    return [
        math.log1p(n), math.log1p(len(words)), sum(map(len, words)) / some,
        share(lambda b: 97 <= b <= 122), share(lambda b: 65 <= b <= 90), share(lambda b: 48 <= b <= 57), share(mark), share(lambda b: b != 10 and b < 128 and chr(b).isspace()), share(lambda b: b == 10), share(lambda b: b >= 127 or (b < 33 and not chr(b).isspace())),
        len(times) / len(words) if words else 0, max(times.values()) / len(words) if words else 0,
        math.log1p(n / len(lines)) if lines else 0, sum(len(x) < 30 for x in lines) / len(lines) if lines else 0, 1 - len(set(lines)) / len(lines) if lines else 0,
        sum(e < n and mark(raw[e]) for _, e in spans) / some, sum(mark(raw[i]) and raw[i] == raw[i - 1] for i in range(1, n)) / some, sum(e - s > 1 and all(65 <= b <= 90 for b in raw[s : s + 2]) for s, e in spans) / some,
    ]


def corpus():
    r = random.Random(11)
    words = ["alpha", "Beta", "gamma", "DELTA", "house", "tree", "été", "stone", "42", "a"]
    for i in range(400):
        good = r.random() < 0.7
        text = ("\n" if i % 7 == 0 else " ").join(r.choices(words, k=r.randrange(1, 60)))
        yield i, text + "." if good else text.replace("a", "!!").upper() + "##", int(good)
    yield from [(400, None, 1), (401, "", 0), (402, "\x00\x7f é", 1)]


def run_query(spark, folder, rows, labels):
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return {r["doc_id"]: r for r in QUERIES["op7_quality"](spark, str(folder)).collect()}


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_query_equals_brute_force(spark, tmp_path):
    rows = list(corpus())
    got = run_query(spark, tmp_path, rows, [(i, y, 0) for i, _, y in rows if i % 3])
    raw = [(t or "").encode() for _, t, _ in rows]
    offsets = np.cumsum([0, *map(len, raw)])
    x = text_statistics(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert np.allclose(x, [plain_statistics(t) for _, t, _ in rows])
    fold = [k for k, (i, *_) in enumerate(rows) if i % 3 and not held(i)]
    model = fit_rules(x[fold], np.array([float(rows[k][2]) for k in fold]))
    want = 1 / (1 + np.exp(-(rule_values(x, model.rules) @ np.array(model.weights) + model.intercept)))
    assert len(got) == len(rows)
    for (i, *_), w in zip(rows, want, strict=True):
        assert abs(got[i]["score"] - w) < 1e-9 and got[i]["held_out"] == held(i) and got[i]["predicted"] == int(w >= 0.7)


def test_labels_of_the_held_out_fold_change_nothing(spark, tmp_path):
    rows = list(corpus())
    labels = [(i, y, 0) for i, _, y in rows]
    first = run_query(spark, tmp_path / "a", rows, labels)
    turned = run_query(spark, tmp_path / "b", rows, [(i, 1 - y if held(i) else y, t) for i, y, t in labels])
    assert {i: r["score"] for i, r in first.items()} == {i: r["score"] for i, r in turned.items()}
    assert sum(map(held, first)) > 50


def test_several_labels_of_an_id_and_repeated_rows(spark, tmp_path):
    rows = [*list(corpus())[:300], *list(corpus())[:2]]
    got = QUERIES["op7_quality"]
    run_query(spark, tmp_path, rows, [(i, y, 0) for i, _, y in rows] + [(1, 0, 0), (1, 1, 0), (None, 1, 0), (2, None, 0)])
    scored = got(spark, str(tmp_path)).collect()
    assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 for r in scored)


def test_an_id_counts_once_in_the_fit(spark):
    rows = data(200)
    docs = spark.createDataFrame([r[:2] for r in rows] + [rows[0][:2]] * 500, "doc_id long, text string")
    labels = [(r[0], r[2]) for r in rows]
    model = fit_quality(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    again = fit_quality(docs, spark.createDataFrame(labels + [(rows[0][0], rows[0][2])] * 300 + [(1, 0)], "doc_id long, quality int"))
    assert (model.rules, model.weights, model.intercept) == (again.rules, again.weights, again.intercept)
