"""Retrieval routes over documents and vectors, fused and re-ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.query import Question
from folioscope.functions.text import match_form, word_tokens
from folioscope.operators import listing, search
from folioscope.operators.textindex import GramIndex, TextIndex
from folioscope.operators.vectorindex import VectorIndex
from folioscope.plans.kept import kept_index, once
from folioscope.plans.registry import Tables, query
from folioscope.session import work_dir

QUESTION = Question("the licensed apache text of with 3.2.1", task="table_qa")

SCORE_SQL = " + ".join(f"CASE WHEN contains(form, '{t}') THEN {w} ELSE 0 END" for t, w in QUESTION.weighted)
FORM_SQL = r"lower(regexp_replace(regexp_replace({}, '\s+', '', 'g'), '[，。；：、“”‘’（）()\[\]【】《》{{}}<>.,;:!?！？·—\-~$\\]', '', 'g'))"


def bm25_sql(tokens: str, query_tokens: list[str], k1: float, top: int) -> str:
    wanted = ", ".join(f"('{t}', {query_tokens.count(t)})" for t in sorted(set(query_tokens)))
    return f"""
        WITH wanted(token, times) AS (VALUES {wanted}), docs AS (SELECT doc_id AS key, {tokens} AS tokens FROM documents), size AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM docs),
        tf AS (SELECT key, len(tokens) AS dl, token, count(*) AS tf FROM (SELECT key, tokens, unnest(tokens) AS token FROM docs) WHERE token IN (SELECT token FROM wanted) GROUP BY ALL),
        df AS (SELECT token, count(*) AS df FROM tf GROUP BY token)
        SELECT key, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * ({k1} + 1) / (tf + {k1} * (0.25 + 0.75 * dl / avgdl))), 6) AS score
        FROM tf JOIN df USING (token) JOIN wanted USING (token), size GROUP BY key ORDER BY score DESC, key LIMIT {top}"""


WORDS = "regexp_extract_all(lower(text), '[一-鿿]|[a-z]+|[0-9]+')"
LETTERS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def best_texts(found: DataFrame, top: int = 20) -> DataFrame:
    """The best of (key, score) in the order of the SQL: by scores as they are returned, so that copies are equal in whatever order their parts were
    summed, and then by the numbers that the index has as text."""
    return found.select(F.col("key").cast("long").alias("key"), F.round("score", 6).alias("score")).orderBy(F.desc("score"), "key").limit(top)


def document_index(t: Tables) -> TextIndex:
    return kept_index(t, "documents", lambda: t.documents, "doc_id", "text")


@query("bm25_paragraph", bm25_sql(WORDS, ["licensed", "under", "the", "apache", "the"], 1.5, 5))
def bm25_paragraph(t: Tables) -> DataFrame:
    """Of a kept index of ideographs, words and numbers; a word that is asked for twice counts twice."""
    index = kept_index(t, "paragraphs", lambda: t.documents, "doc_id", "text", tokens=word_tokens)
    return best_texts(index.bm25(search.paragraph_tokens("licensed under the Apache the"), k1=1.5), 5)


@query("fts_search", bm25_sql(LETTERS, ["reaux", "étion", "gnu"], 1.2, 20))
def fts_search(t: Tables) -> DataFrame:
    """Of the kept index, the buckets of three tokens."""
    return best_texts(document_index(t).bm25(["reaux", "étion", "gnu"]))


#: Letters as ideographs, so that words become runs of them and their pairs tokens.
LATIN, IDEOGRAPHS = "abcdefghijklmnopqrstuvwxyz", "一丁七万丈三上下不与丐丑专且世丘丙业丛东丝丢两严丧个"
CJK_TERMS = "".join(IDEOGRAPHS[LATIN.index(c)] for c in "licensed")


CJK_RUNS = rf"regexp_extract_all(regexp_replace(translate(lower(text), '{LATIN}', '{IDEOGRAPHS}'), '([一-鿿]+)', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+')"
CJK_PAIRS = f"flatten([CASE WHEN length(r) > 1 AND regexp_matches(r, '[一-鿿]') THEN [substr(r, i, 2) FOR i IN range(1, length(r))] ELSE [r] END FOR r IN {CJK_RUNS}])"


@query("cjk_search", bm25_sql(CJK_PAIRS, search.asked_tokens(CJK_TERMS), 1.2, 20))
def cjk_search(t: Tables) -> DataFrame:
    """Full-text search over pairs of ideographs: the documents with their letters written as such."""
    texts = t.documents.select("doc_id", F.translate(F.lower("text"), LATIN, IDEOGRAPHS).alias("text"))
    index = kept_index(t, "ideographs", lambda: texts, "doc_id", "text")
    return best_texts(index.bm25(search.asked_tokens(CJK_TERMS)))


REBUILT_SQL = "FROM (SELECT doc_id, CASE WHEN lang = 'fr' THEN text || ' gnu nation ' || doc_id ELSE text END AS text FROM documents WHERE lang IS DISTINCT FROM 'de'))"


@query("fts_rebuild", bm25_sql(LETTERS, ["reaux", "étion", "gnu", "nation"], 1.2, 20).replace("FROM documents)", REBUILT_SQL))
def fts_rebuild(t: Tables) -> DataFrame:
    """The index after documents of one language were replaced and those of another removed, without a rebuild of the others."""
    index = TextIndex(t.spark, work_dir(t.spark))
    index.replace("load", t.documents, "doc_id", "text")
    changed = t.documents.where("lang = 'fr'").select("doc_id", F.concat_ws(" ", "text", F.lit("gnu nation"), "doc_id").alias("text"))
    index.replace("change", changed, "doc_id", "text", removed=t.documents.where("lang = 'de'").select("doc_id"))
    return best_texts(index.bm25(["reaux", "étion", "gnu", "nation"]))


@query(
    "tfidf_bigram_recall",
    """WITH docs AS (SELECT conv_id || ':' || turn || ':' || role AS key, text, FALSE AS asked FROM conversations WHERE text IS NOT NULL UNION ALL SELECT NULL, 'how do I sort a list', TRUE),
       grams AS (SELECT key, asked, [substr(text, i, 2) for i in range(1, length(text))] AS grams FROM docs),
       tf AS (SELECT key, asked, len(grams) AS total, gram, count(*) AS tf FROM (SELECT key, asked, grams, unnest(grams) AS gram FROM grams) GROUP BY ALL),
       df AS (SELECT gram, count(*) AS df, max(CASE WHEN asked THEN tf / total END) AS q FROM tf GROUP BY gram), size AS (SELECT count(*) AS n FROM docs),
       parts AS (SELECT key, tf / total * ln(n / df) AS w, coalesce(q, 0) * ln(n / df) AS q FROM tf JOIN df USING (gram), size WHERE NOT asked),
       norm AS (SELECT sqrt(sum(pow(q * ln(n / df), 2))) AS norm FROM df, size WHERE q IS NOT NULL)
       SELECT key, round(sum(w * q) / (sqrt(sum(w * w)) * max(norm)), 6) AS score FROM parts, norm GROUP BY key HAVING sum(w * q) / (sqrt(sum(w * w)) * max(norm)) >= 0.02 ORDER BY score DESC, key LIMIT 5""",
)
def tfidf_bigram_recall(t: Tables) -> DataFrame:
    def load() -> GramIndex:
        index = GramIndex(t.spark, work_dir(t.spark))
        index.load(t.conversations.where("text IS NOT NULL").select(F.concat_ws(":", "conv_id", "turn", "role").alias("key"), "text"), "key", "text")
        return index

    return once(t, "pairs of turns", "conversations", load).recall("how do I sort a list").withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "key")


@query(
    "dense_topk",
    """WITH q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1)
       SELECT vec_id AS key, round(list_dot_product(embedding::DOUBLE[], v::DOUBLE[]), 6) AS score FROM embeddings, q ORDER BY list_dot_product(embedding::DOUBLE[], v::DOUBLE[]) DESC, vec_id LIMIT 24""",
)
def dense_topk(t: Tables) -> DataFrame:
    first = t.embeddings.orderBy("vec_id").select("embedding").first()
    return search.vector_top(t.embeddings, "vec_id", "embedding", first[0] if first else [], top=search.dense_limit(3)).withColumn("score", F.round("score", 6))


@query(
    "cosine_topk",
    """WITH q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id DESC LIMIT 1)
       SELECT vec_id AS key, round(greatest(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 0), 6) AS score FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]) DESC, vec_id LIMIT 40""",
)
def cosine_topk(t: Tables) -> DataFrame:
    last = t.embeddings.orderBy(F.desc("vec_id")).select("embedding").first()
    return search.vector_top(t.embeddings, "vec_id", "embedding", last[0] if last else [], top=40, cosine=True).withColumn("score", F.round("score", 6))


@query(
    "hash_embedding",
    """WITH terms AS (SELECT doc_id AS key, md5(unnest(regexp_extract_all(lower(text), '[一-鿿]|[a-z]+|[0-9]+'))) AS h FROM documents),
       sums AS (SELECT key, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 256 AS bucket, sum(CASE WHEN CAST('0x' || substr(h, 9, 2) AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS value FROM terms GROUP BY 1, 2),
       norms AS (SELECT key, sqrt(sum(value * value)) AS norm FROM sums GROUP BY key)
       SELECT key, bucket, round(value / norm, 6) AS value FROM sums JOIN norms USING (key) WHERE norm > 0 AND value <> 0""",
)
def hash_embedding(t: Tables) -> DataFrame:
    return search.hash_embedding(t.documents, "doc_id", search.word_tokens(F.col("text"))).withColumn("value", F.round("value", 6))


@query(
    "sparse_score",
    f"""WITH {{blocks}}, rows AS (SELECT block_id, clause_id, text, {FORM_SQL.format("clause_id || chr(10) || text")} AS form FROM blocks)
        SELECT block_id, round({SCORE_SQL} + CASE WHEN contains(form, '3') THEN 1 ELSE 0 END + CASE WHEN contains(form, '2') THEN 1 ELSE 0 END + CASE WHEN contains(form, '1') THEN 1 ELSE 0 END
               + CASE WHEN regexp_matches(clause_id || chr(10) || text, '(^|[^0-9.])3\\.2\\.1([^0-9.]|$)') THEN 6 ELSE 0 END + CASE WHEN contains(form, '{QUESTION.form}') THEN 4 ELSE 0 END, 6) AS score FROM rows""",
)
def sparse_score(t: Tables) -> DataFrame:
    rows = t.blocks.withColumn("form", match_form(search.raw_text(F.col("clause_id"), F.col("text"))))
    return rows.select("block_id", F.round(search.sparse_score(F.col("clause_id"), F.col("text"), QUESTION, F.col("form")), 6).alias("score"))


@query(
    "dense_score",
    f"""WITH rows AS (SELECT doc_id, text, doc_id % 7 / 10 - 0.1 AS sim, {FORM_SQL.format("source || chr(10) || text")} AS form FROM documents)
        SELECT doc_id, round(greatest(0, sim) + least(0.18, ({SCORE_SQL}) * 0.015), 6) AS score FROM rows""",
)
def dense_score(t: Tables) -> DataFrame:
    plain = Question("the licensed apache text of with", task="definition_qa")
    return t.documents.select("doc_id", search.dense_score(F.col("doc_id") % 7 / 10 - 0.1, F.col("source"), F.col("text"), plain).alias("score"))


@query(
    "rrf_fusion",
    """WITH rows AS (SELECT 'sparse' AS route, CAST(p_partkey AS VARCHAR) AS item, CAST(p_size AS DOUBLE) AS score FROM part UNION ALL SELECT 'dense', CAST(p_partkey AS VARCHAR), CAST(p_retailprice AS DOUBLE) FROM part),
       normal AS (SELECT route, item, round(score / max(score) OVER (PARTITION BY route), 6) AS normal FROM rows),
       ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY route ORDER BY normal DESC, item DESC) - 1 AS rank FROM normal) WHERE rank < 1000)
       SELECT item AS key, round(sum(CASE route WHEN 'sparse' THEN 1.3 ELSE 0.9 END / (60 + rank) + 0.1), 6) AS fusion_score, string_agg(route, ',' ORDER BY route) AS routes FROM ranked GROUP BY item
       ORDER BY fusion_score DESC, max_by(normal, 1.0 / (60 + rank) * CASE route WHEN 'sparse' THEN 1.3 ELSE 0.9 END) DESC, length(item), item LIMIT 20""",
)
def rrf_fusion(t: Tables) -> DataFrame:
    """Two routes over all parts; each route's best thousand are fused."""
    base = t.part.select(F.col("p_partkey").cast("string").alias("item_id"), F.col("p_partkey").alias("doc_id"), F.lit("content").alias("kind"), F.lit("").alias("title"), F.col("p_partkey").cast("string").alias("text"), "p_size", "p_retailprice")
    rest = [F.lit(None).cast("string").alias("target_id"), F.lit(None).cast("string").alias("table_id"), F.lit("body").alias("section_path"), F.lit(3).alias("page_idx")]
    own = ["item_id", "doc_id", "kind", "title", "text"]
    sparse = base.select(F.lit("sparse").alias("route"), *own, F.col("p_size").cast("double").alias("score"), *rest)
    dense = base.select(F.lit("dense").alias("route"), *own, F.col("p_retailprice").alias("score"), *rest)
    fused = search.fuse(sparse.unionByName(dense), task="definition_qa", top=20, weights={"sparse": 1.3, "dense": 0.9})
    return fused.select("key", "fusion_score", "routes")


@query(
    "reference_search",
    """WITH rows AS (SELECT p_partkey, lower(p_name) AS name, lower(p_brand) AS brand, lower(p_type) AS kind FROM part), asked AS (SELECT unnest(['red', 'red bolt', 'bolt']) AS q),
       scored AS (SELECT q AS asked, p_partkey, CASE WHEN name = q THEN 24 WHEN starts_with(name, q) THEN 18 WHEN contains(name, q) THEN 14 ELSE 0 END + CASE WHEN contains(brand, q) THEN 4 ELSE 0 END + CASE WHEN contains(kind, q) THEN 2.5 ELSE 0 END AS score FROM rows, asked)
       SELECT asked, p_partkey, score FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY score DESC, p_partkey) AS n FROM scored WHERE score > 0) WHERE n <= 20""",
)
def reference_search(t: Tables) -> DataFrame:
    """What three mentions may refer to: a whole name, the beginning and the end of one."""
    found = [listing.reference_search(t.part, "p_partkey", "p_name", {"p_brand": 4.0, "p_type": 2.5}, asked).select(F.lit(asked).alias("asked"), "p_partkey", "score") for asked in ("red", "red bolt", "bolt")]
    return found[0].union(found[1]).union(found[2])


# ---------------------------------------------------------------- vector index


def vector_index(t: Tables) -> VectorIndex:
    """The kept index of all vectors."""

    def build() -> VectorIndex:
        index = VectorIndex(t.spark, work_dir(t.spark))
        index.fit(t.embeddings, "vec_id", "embedding")
        index.replace("load", t.embeddings, "vec_id", "embedding")
        return index

    return once(t, "vector index", "embeddings", build)


@query(
    "ann_exact",
    """WITH q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id DESC LIMIT 1)
       SELECT vec_id AS key, round(greatest(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 0), 6) AS score FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]) DESC, vec_id LIMIT 40""",
)
def ann_exact(t: Tables) -> DataFrame:
    """The index with all of its cells and no estimates."""
    last = t.embeddings.orderBy(F.desc("vec_id")).select("embedding").first()
    found = vector_index(t).search(last[0] if last else [], top=40, probes=None)
    return found.select(F.col("key").cast("long").alias("key"), F.round("score", 6).alias("score"))


@query("ann_recall", "SELECT count(*) AS questions, 10 AS top, TRUE AS reached FROM embeddings WHERE vec_id % 50 = 0")
def ann_recall(t: Tables) -> DataFrame:
    """Whether the nearest ten of every fiftieth vector are found, on average 0.9 of them, in the probed cells by their estimates."""
    index = vector_index(t)
    asked = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("vector"))
    found = index.search_all(asked, top=10)
    exact = index.search_all(asked, top=10, probes=None)
    hits = exact.join(found.select("query_id", "key", F.lit(1).alias("hit")), ["query_id", "key"], "left")
    return hits.agg(F.count_distinct("query_id").alias("questions"), F.lit(10).alias("top"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("reached"))
