"""The routes' candidates come from the blocks of all documents, with the scores that plain Python gives."""

import re

from folioscope.functions.query import plain_form
from folioscope.operators import retrieval
from folioscope.plans import routes
from folioscope.plans.registry import Tables


def lines(docs):
    for doc_id, text in docs:
        for pos, line in enumerate(text.split("\n") if text is not None else []):
            yield f"{doc_id}:{pos}", f"{doc_id % 9 + 1}.{pos // 20 + 1}.{pos % 5 + 1}", line


def has_clause(text, ref):
    return re.search(rf"(?<![\d.]){re.escape(ref)}(?![\d.])", text) is not None


def score(clause, line, question):
    raw = f"{clause}\n{line}"
    form = plain_form(raw)
    out = sum(w for t, w in question.weighted if t in form) + sum(t in form for t in question.tokens if t.isdigit()) + 4 * (question.form in form)
    return out + 6 * sum(has_clause(raw, c) for c in question.clauses)


def test_routes_score_all_documents(spark, tmp_path):
    words = ["licensed", "apache", "text of", "with care", "plain", "3.2.1", "the", "nothing"]
    docs = [(i, "\n".join(words[(i * 5 + pos * 3) % 8] + " " + words[(i + pos) % 7] for pos in range(45))) for i in (2, 299, 300, 301, 4000)]
    docs += [(5000, "\n".join(["the licensed apache text of with 3.2.1"] * 30)), (5001, None), (5002, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tables, question = Tables(spark, str(tmp_path)), routes.QUESTION

    found = retrieval.sparse(routes.targets(tables), routes.chunks(tables), routes.blocks(tables), question, top=routes.TOP).collect()
    got = {r["item_id"]: r["score"] for r in found if r["target_id"] and r["section_path"]}
    want = sorted((-round(0.85 * (score(c, x, question) + 8 * has_clause(f"{c}\n{x}", "3.2.1")), 6), key) for key, c, x in lines(docs) if "3.2.1" in x)[:60]
    assert got.keys() == {key for _, key in want} and all(abs(got[key] + s) < 1e-6 for s, key in want)
    assert {r["doc_id"] for r in found} >= {4000, 5000}

    clauses = {r["item_id"]: r["score"] for r in retrieval.clause(routes.blocks(tables), question, top=routes.TOP).collect()}
    near = sorted((c, key) for key, c, _ in lines(docs) if c == "3.2.1" or c.startswith("3.2.1.") or "3.2.1".startswith(c + "."))[:20]
    assert clauses == {key: 14.0 if c == "3.2.1" else 12.0 for c, key in near}


def test_copies_are_in_the_order_of_the_sql(spark, tmp_path):
    """More copies than are asked for: the smallest numbers of them are found, not the first as text, however their parts were summed."""
    import duckdb

    from folioscope import catalog

    same = "gnu réaux reaux étion licensed under the apache nation"
    docs = [(i, same, "en") for i in (7, 8, 9, 10, 11, *range(95, 130))] + [(1000 + i, f"other words {i}", "fr" if i % 2 else "de") for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("fts_search", "bm25_paragraph", "cjk_search", "fts_rebuild", "index_upkeep"):
        want = duck.execute(catalog.ORACLE_SQL[name]).fetchall()
        assert [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).select("key", "score").collect()] == want, name
        assert want[:4] == [(i, want[0][1]) for i in (7, 8, 9, 10)], name


def test_scores_that_are_returned_alike_are_ties(spark):
    from folioscope.plans.ranking import best_texts

    found = spark.createDataFrame([("10", 1.0000002), ("9", 1.0000001), ("8", 0.9999999), ("7", 0.5), ("100", 2.0)], "key string, score double")
    assert [tuple(r) for r in best_texts(found, 4).collect()] == [(100, 2.0), (8, 1.0), (9, 1.0), (10, 1.0)]
