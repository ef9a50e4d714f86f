"""Retrieval routes, their fusion and re-ranking."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.query import Question
from folioscope.functions.text import bigrams, contains_clause, let, match_form, word_tokens
from folioscope.operators.listing import contents_page

RRF_K = 60
#: Weights of the routes; a table of one's own may replace them.
ROUTE_WEIGHTS = {"dense": 1.0, "sparse": 1.0, "clause": 1.6, "table": 1.0, "formula": 1.0}
#: Weight of dense candidates whose vectors are only hashed.
HASHED_WEIGHT = 0.05


# ---------------------------------------------------------------- term routes


def postings(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, token, tf, dl) of token arrays: what BM25 needs of each text."""
    rows = docs.select(F.col(key).alias("key"), tokens.alias("tokens"))
    rows = rows.select("key", F.size("tokens").alias("dl"), F.explode("tokens").alias("token"))
    return rows.groupBy("key", "token", "dl").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, key: str, tokens: Column, query: Sequence[str], *, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(key, score) of texts with any query token.

    Document frequencies and lengths cover all texts. Only query tokens are exploded, so the shuffle
    grows with the hits and not with the corpus; the statistics are one row each.
    """
    wanted = sorted(set(query))
    rows = docs.select(F.col(key).alias("key"), tokens.alias("tokens")).select("key", F.size("tokens").alias("dl"), F.filter("tokens", lambda t: t.isin(*wanted)).alias("hits"))
    size = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tf = rows.where(F.size("hits") > 0).select("key", "dl", F.explode("hits").alias("token")).groupBy("key", "token", "dl").agg(F.count("*").alias("tf"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))  # at most one row per query token
    times = F.create_map(*(F.lit(x) for t in wanted for x in (t, list(query).count(t))))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = F.element_at(times, F.col("token")) * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = tf.join(F.broadcast(df), "token").join(F.broadcast(size)).select("key", part.alias("part"))
    return scored.groupBy("key").agg(F.sum("part").alias("score"))


def paragraph_tokens(query: str) -> list[str]:
    """Ideographs, words and numbers of a question, by the rules of word_tokens."""
    return re.findall("[一-鿿]|[a-z]+|\\d+", query.lower())


def paragraph_search(docs: DataFrame, key: str, text: str, query: str, *, top: int = 5) -> DataFrame:
    """The best texts by BM25 over ideographs, words and numbers."""
    return bm25(docs, key, word_tokens(F.col(text)), paragraph_tokens(query)).orderBy(F.desc("score"), "key").limit(top)


def index_tokens(text: Column) -> Column:
    """Tokens of full-text search: letter and digit runs in lower case, and pairs within runs of ideographs.

    Where a text has ideographs, one pass finds what begins at each place: a pair, an ideograph alone, or the first letter of another run. Java looks
    back one UTF-16 unit only, so texts with characters of two are cut into runs first.
    """
    lower, whole = F.lower(F.coalesce(text, F.lit(""))), F.lit(0)
    other = "[\\p{L}\\p{N}&&[^一-鿿]]"
    here = f"(?=([一-鿿]{{2}}|(?<![一-鿿])[一-鿿](?![一-鿿])|(?<!{other}){other}+))"
    cut = F.transform(F.regexp_extract_all(lower, F.lit(f"[一-鿿]+|{other}+"), whole), lambda r: F.when(r.rlike("^[一-鿿]{2,}$"), bigrams(r)).otherwise(F.array(r)))
    plain = F.when(lower.rlike("[一-鿿]"), F.regexp_extract_all(lower, F.lit(here), F.lit(1))).otherwise(F.regexp_extract_all(lower, F.lit(f"{other}+"), whole))
    return F.when(lower.rlike("[\\x{10000}-\\x{10FFFF}]"), F.flatten(cut)).otherwise(plain)


def index_runs(text: Column) -> Column:
    """The runs that index_tokens has its tokens from, in lower case: each is a token, or holds the pairs of run_pairs."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[一-鿿]+|[\\p{L}\\p{N}&&[^一-鿿]]+"), F.lit(0))


def run_pairs(run: str) -> list[str]:
    """The tokens of a run: its pairs if it is of two ideographs or more, else itself."""
    return [run] if len(run) < 2 or not "一" <= run[0] <= "鿿" else [run[i : i + 2] for i in range(len(run) - 1)]


def asked_tokens(text: str) -> list[str]:
    """Tokens of a question, by the same rules."""
    runs = re.findall(r"[一-鿿]+|(?:(?![一-鿿])[^\W_])+", text.lower())
    pairs = ([r] if r[0] < "一" or r[0] > "鿿" or len(r) < 2 else [r[i : i + 2] for i in range(len(r) - 1)] for r in runs)
    return list(dict.fromkeys(t for ts in pairs for t in ts))


def has_token(text: Column, asked: Sequence[str]) -> Column:
    """Whether a text has any of the tokens (of asked_tokens): what index_tokens has of it, found without making all tokens of the text."""
    lower, other = F.lower(F.coalesce(text, F.lit(""))), "[\\p{L}\\p{N}&&[^一-鿿]]"
    pairs = [t for t in asked if len(t) > 1 and "一" <= t[0] <= "鿿"]
    alone = [t for t in asked if len(t) == 1 and "一" <= t <= "鿿"]
    runs = [f"(?={other}{{{len(t)}}}(?!{other})){t}" for t in asked if not "一" <= t[0] <= "鿿"]
    parts = [*pairs, *([f"(?<![一-鿿])[{''.join(alone)}](?![一-鿿])"] if alone else ()), *([f"(?<!{other})(?:{'|'.join(runs)})"] if runs else ())]
    listed = F.arrays_overlap(index_tokens(text), F.array(*map(F.lit, asked)).cast("array<string>"))

    def found(own: Column) -> Column:
        """Most texts without a token don't have its letters either, which a plain search tells."""
        exact = F.when(own.rlike("[\\x{10000}-\\x{10FFFF}]"), listed).otherwise(own.rlike("|".join(parts)))
        return reduce(or_, (F.contains(own, F.lit(t)) for t in asked)) & exact

    return let(lower, found) if asked else F.lit(False)


def fts_search(docs: DataFrame, key: str, text: str, terms: Sequence[str], *, top: int = 20) -> DataFrame:
    """Any-term full-text search ranked by BM25 (k1 1.2, b 0.75)."""
    return bm25(docs, key, index_tokens(F.col(text)), list(dict.fromkeys(terms)), k1=1.2).orderBy(F.desc("score"), "key").limit(top)


def term_counts(terms: Column) -> Column:
    """Distinct terms of an array with how often each occurs, as structs (term, n): counted within the row, in sorted order."""

    def runs(ordered: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(ordered) - 1)
        heads = F.filter(places, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        return let(heads, lambda at: F.transform(at, lambda i, k: F.struct(F.get(ordered, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(ordered)) - i).alias("n"))))

    return F.when(F.size(terms) > 0, let(F.array_sort(terms), runs)).otherwise(F.array().cast("array<struct<term:string,n:int>>"))


def tfidf_recall(docs: DataFrame, key: str, text: str, query: str, *, top: int = 5, least: float = 0.02) -> DataFrame:
    """Cosine of TF-IDF vectors of character pairs; frequencies count the query as one more text.

    Pairs are counted within each row, so what is shuffled are the frequencies, combined in every task, and one sum a
    text; the table of frequencies is joined by broadcast where Spark finds it small.
    """
    grams = [query[i : i + 2] for i in range(len(query) - 1)]
    asked = {g: grams.count(g) / len(grams) for g in sorted(set(grams))}
    told = F.create_map(*(F.lit(x) for pair in asked.items() for x in pair)) if asked else F.create_map().cast("map<string,double>")
    rows = docs.select(F.col(key).alias("key"), bigrams(F.coalesce(F.col(text), F.lit(""))).alias("grams")).select("key", F.size("grams").alias("total"), term_counts(F.col("grams")).alias("counts"))
    n = rows.agg((F.count("*") + 1).alias("n"))
    entries = rows.select("key", "total", F.explode("counts").alias("c")).select("key", F.col("c.term").alias("gram"), (F.col("c.n") / F.col("total")).alias("tf"))
    question = docs.sparkSession.createDataFrame([(g,) for g in asked], "gram string") if asked else docs.sparkSession.createDataFrame([], "gram string")
    seen = entries.groupBy("gram").agg(F.count("*").alias("df")).unionByName(question.withColumn("df", F.lit(1).cast("long")))
    df = seen.groupBy("gram").agg(F.sum("df").alias("df"))
    weighed = df.join(F.broadcast(n)).select("gram", F.log(F.col("n") / F.col("df")).alias("idf"), F.coalesce(F.try_element_at(told, F.col("gram")), F.lit(0.0)).alias("query_tf"))
    norm = weighed.where("query_tf > 0").agg(F.sqrt(F.sum((F.col("query_tf") * F.col("idf")) ** 2)).alias("norm"))
    own = F.col("tf") * F.col("idf")
    cosine = entries.join(weighed, "gram").groupBy("key").agg(F.sum(own * F.col("query_tf") * F.col("idf")).alias("dot"), F.sqrt(F.sum(own**2)).alias("own"))
    scored = cosine.join(F.broadcast(norm)).select("key", F.when((F.col("own") > 0) & (F.col("norm") > 0), F.col("dot") / (F.col("own") * F.col("norm"))).otherwise(0.0).alias("score"))
    return scored.where(F.col("score") >= least).orderBy(F.desc("score"), "key").limit(top)


def lexical_overlap(form: Column, question: Question) -> Column:
    """Sum of the weights of the question's tokens that occur in a text's match form; plain numbers don't count."""
    score = F.lit(0.0)
    for token, weight in question.weighted:
        score = score + F.when(F.contains(form, F.lit(token)), weight).otherwise(0.0)
    return score


def raw_text(title: Column, text: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))


def sparse_score(title: Column, text: Column, question: Question, form: Column | None = None) -> Column:
    """Token weights, 6 for each exact clause number, 4 for the whole question. Numbers count 1 in table tasks.

    form: a column with the match form of title and text, where there is one.
    """
    raw = raw_text(title, text)

    def score(form: Column) -> Column:
        out = lexical_overlap(form, question)
        if question.task in ("table_qa", "table_explain"):
            for token in filter(str.isdigit, question.tokens):
                out = out + F.when(F.contains(form, F.lit(token)), 1.0).otherwise(0.0)
        if question.form:
            out = out + F.when(F.contains(form, F.lit(question.form)), 4.0).otherwise(0.0)
        for ref in question.clauses:
            out = out + F.when(contains_clause(raw, ref), 6.0).otherwise(0.0)
        return F.when(form == "", 0.0).otherwise(out)

    return let(match_form(raw), score) if form is None else score(form)


# ---------------------------------------------------------------- vector routes


def dot(a: Column, b: Column) -> Column:
    """Dot product as double; 0 for empty vectors and different lengths."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), product).otherwise(0.0)


def unit(v: Column) -> Column:
    """Vector of length 1; zero vectors stay."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return let(norm, lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double"))))


def vector_top(vectors: DataFrame, key: str, vector: str, query: Sequence[float], *, top: int, cosine: bool = False) -> DataFrame:
    """(key, score) of the nearest vectors, exactly: each task keeps its own best, so only those are shuffled."""
    wanted = F.array(*(F.lit(float(x)) for x in query))
    score = F.greatest(dot(unit(F.col(vector)), unit(wanted)), F.lit(0.0)) if cosine else dot(F.col(vector), wanted)
    return vectors.select(F.col(key).alias("key"), score.alias("score")).orderBy(F.desc("score"), "key").limit(max(1, min(200, top)))


def dense_limit(top: int) -> int:
    return max(24, 8 * top)


def dense_score(similarity: Column, title: Column, text: Column, question: Question, form: Column | None = None) -> Column:
    """Similarity, a little for shared tokens, 0.20 for a clause number, 0.08 where a calculation is asked for and shown."""
    raw = raw_text(title, text)
    overlap = let(match_form(raw), lambda own: lexical_overlap(own, question)) if form is None else lexical_overlap(form, question)
    score = F.greatest(F.lit(0.0), similarity) + F.least(F.lit(0.18), overlap * 0.015)
    clause = F.lit(False)
    for ref in question.clauses:
        clause = clause | contains_clause(raw, ref)
    score = score + F.when(clause, 0.20).otherwise(0.0)
    if any(m in question.text for m in ("怎么计算", "如何计算", "计算方法", "按什么计算", "按式", "公式")):
        score = score + F.when(F.regexp_like(F.coalesce(text, F.lit("")), F.lit("按式|公式|式中|计算")), 0.08).otherwise(0.0)
    return F.round(score, 6)


def hash_embedding(docs: DataFrame, key: str, terms: Column, *, dimension: int = 256) -> DataFrame:
    """(key, bucket, value): sparse unit vectors of hashed terms. The first four bytes of a term's MD5 pick the bucket,
    the parity of the fifth the sign."""
    rows = docs.select(F.col(key).alias("key"), F.explode(terms).alias("term"))
    digest = F.md5(F.col("term"))
    bucket = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(dimension))
    sign = F.when(F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    sums = rows.groupBy("key", bucket.alias("bucket")).agg(F.sum(sign).alias("value"))
    norms = sums.groupBy("key").agg(F.sqrt(F.sum(F.col("value") ** 2)).alias("norm"))
    return sums.join(norms, "key").where("norm > 0 AND value <> 0").select("key", "bucket", (F.col("value") / F.col("norm")).alias("value"))


# ---------------------------------------------------------------- fusion


def candidate_key(rows: DataFrame) -> Column:
    """One key for what is the same piece of evidence: citation target, else table, formula or figure, else the item itself."""
    kind = F.coalesce(F.col("kind"), F.lit(""))
    target = F.nullif(F.trim(F.coalesce(F.col("target_id"), F.lit(""))), F.lit(""))
    table = F.nullif(F.coalesce(F.col("table_id"), F.lit("")), F.lit(""))
    return (
        F.when(target.isNotNull(), F.concat(F.lit("target:"), target))
        .when(kind.startswith("table_") & table.isNotNull(), F.concat(F.lit("table:"), table))
        .when(kind.isin("formula_block", "formula_context", "formula_clause"), F.concat(F.lit("formula:"), F.regexp_replace("item_id", ":[^:]*$", "")))
        .when(kind == "figure", F.concat(F.lit("figure:"), F.col("item_id")))
        .otherwise(F.col("item_id"))
    )


def task_bonus(task: str, route: Column, kind: Column, toc: Column) -> Column:
    """What a task adds to a candidate; the first rule that fits decides."""
    tables = ("table_row_key", "table_schema", "table_summary", "table_text_row", "table_mapping_row")
    out = F.when(route == "clause", 1.0).when(toc, 0.12 if task == "locate_qa" else -0.35)
    rules = {
        "locate_figure": [(kind == "figure", 0.45)],
        "locate_table": [(kind == "table", 0.45)],
        "locate_formula": [(kind.isin("formula", "formula_param"), 0.50)],
        "locate_clause": [(kind == "title", 0.35)],
        "table_qa": [(kind.isin(*tables), 0.35), (kind.startswith("table_"), 0.25)],
        "table_explain": [(kind.isin(*tables), 0.35)],
        "locate_qa": [(kind.isin("outline_anchor", "title"), 0.20)],
        "definition_qa": [(kind.isin("content", "schema_desc"), 0.10)],
    }
    for test, bonus in rules.get(task, []):
        out = out.when(test, bonus)
    return out.otherwise(0.0)


def fuse(candidates: DataFrame, *, task: str, top: int, weights: Mapping[str, float] = ROUTE_WEIGHTS, hashed: bool = False, depth: int | None = 1000) -> DataFrame:
    """Reciprocal-rank fusion of the best `depth` candidates of each route (None: of all).

    candidates: route, item_id, doc_id, kind, title, text, score, target_id, table_id, section_path, page_idx.
    Within a route scores are divided by the route's highest and the best candidate of each key stays;
    each adds weight / (60 + rank) and its task bonus to the key. The text of the strongest
    contribution represents the key. Contents pages come last resort, except when locating.
    """
    route, key = Window.partitionBy("route"), Window.partitionBy("route", "key")
    rows = candidates.withColumn("key", candidate_key(candidates))
    highest = rows.groupBy("route").agg(F.max("score").alias("highest"))  # one row a route
    rows = rows.join(F.broadcast(highest), "route").withColumn("normal", F.round(F.col("score") / F.coalesce(F.nullif("highest", F.lit(0.0)), F.lit(1.0)), 6))
    best = rows.groupBy("route", "key").agg(F.max_by(F.struct("item_id", "doc_id", "kind", "title", "text", "normal", "table_id", "section_path", "page_idx"), F.struct("normal", "item_id", "text")).alias("own")).select("route", "key", "own.*")
    # With a depth, Spark keeps the best of each task before it ranks a route, so no task gets a whole route.
    ranked = best.withColumn("rank", F.row_number().over(route.orderBy(F.desc("normal"), F.desc("item_id"))))
    ranked = (ranked if depth is None else ranked.where(F.col("rank") <= depth)).withColumn("rank", F.col("rank") - 1)
    factor = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, w in weights.items() for x in (k, HASHED_WEIGHT if hashed and k == "dense" else w))), F.col("route")), F.lit(1.0))
    toc = contents_page(F.col("title"), F.col("section_path"), F.col("text"), F.col("kind"), F.col("page_idx"))
    ranked = ranked.withColumn("toc", toc).withColumn("part", factor / (RRF_K + F.col("rank")) + task_bonus(task, F.col("route"), F.coalesce("kind", F.lit("")), toc))
    fused = ranked.groupBy("key").agg(
        F.round(F.sum("part"), 6).alias("fusion_score"),
        F.array_join(F.array_sort(F.collect_set("route")), ",").alias("routes"),
        F.max_by(F.struct("item_id", "doc_id", "kind", "title", "text", "normal", "table_id", "toc"), F.struct("part", "route")).alias("own"),
    )
    fused = fused.select("key", "fusion_score", "routes", "own.*")
    if task != "locate_qa":
        some = fused.agg(F.coalesce(F.max(~F.col("toc")), F.lit(False)).alias("some"))
        fused = fused.join(F.broadcast(some)).where(~F.col("toc") | ~F.col("some")).drop("some")
    return fused.orderBy(F.desc("fusion_score"), F.desc("normal"), F.char_length("text"), "key").limit(max(1, min(20, top))).drop("toc")


def has_phrase(raw: Column, question: Question) -> Column:
    """Whether a text has any phrase of the question."""
    phrases = F.array(*map(F.lit, question.phrases)).cast("array<string>")
    return let(match_form(raw), lambda form: F.exists(phrases, lambda p: F.contains(form, p)))


def phrase_rerank(fused: DataFrame, question: Question) -> DataFrame:
    """Adds what phrases of the question, the task and the kind of a candidate are worth."""
    hit = has_phrase(F.concat_ws("\n", "title", "text"), question)
    kind = F.coalesce(F.col("kind"), F.lit(""))
    bonus = F.when(hit, 0.15).otherwise(0.0) + F.when(kind.isin("formula_block", "formula_context", "formula_clause"), 0.12).otherwise(0.0)
    if question.task == "table_qa":
        bonus = bonus + F.when(kind.startswith("table_"), 0.10).otherwise(0.0)
    if question.task == "definition_qa":
        bonus = bonus + F.when(kind.isin("formula", "title", "outline_anchor"), 0.10).otherwise(0.0)
    if question.task == "locate_qa":
        bonus = bonus + F.when(kind.isin("outline_anchor", "title"), 0.08).otherwise(0.0)
    return fused.withColumn("rerank_score", F.round(F.col("fusion_score") + bonus, 6)).orderBy(F.desc("rerank_score"), F.desc("normal"), F.char_length("text"), "key")


def sufficient(lead_title: Column, lead_text: Column, lead_score: Column, lead_kind: Column, question: Question) -> Column:
    """Whether the first candidate carries an answer: a phrase, a clause number, or a high score."""
    raw = F.concat_ws("\n", lead_title, lead_text)
    hit = has_phrase(raw, question)
    for ref in question.clauses:
        hit = hit | contains_clause(raw, ref)
    strong = lead_kind.isin("formula_block", "formula_context", "formula_clause", "table_row_key", "table_schema", "table_mapping_row") & (lead_score >= 3.0)
    return hit | strong | (lead_score >= 8.0)
