"""Listings, filters and statistics over documents, blocks, records and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as fn
from folioscope.operators import listing, stats
from folioscope.plans.registry import Tables, query


@query(
    "list_blocks",
    """WITH {blocks} SELECT doc_id, block_id, block_type, text FROM blocks
       WHERE block_type IN ('title', 'list_item') AND contains(lower(text), 'the') ORDER BY doc_id, page_idx, reading_order LIMIT 200""",
)
def list_blocks(t: Tables) -> DataFrame:
    return listing.listing(t.blocks, kinds=["title", "list_item"], keyword="The", order=["doc_id", "page_idx", "reading_order"], limit=200).select("doc_id", "block_id", "block_type", "text")


@query("list_pages", "WITH {blocks} SELECT doc_id, page_idx, count(*) AS n_blocks, sum(length(text))::BIGINT AS n_chars FROM blocks GROUP BY doc_id, page_idx")
def list_pages(t: Tables) -> DataFrame:
    return listing.pages(t.blocks)


@query("record_page", "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '1970-01-01' ORDER BY ts DESC, event_id LIMIT 50 OFFSET 100")
def record_page(t: Tables) -> DataFrame:
    rows = t.events.where("event_type = 'click' AND ts >= TIMESTAMP '1970-01-01'")
    return listing.page(rows, order=[F.desc("ts"), F.col("event_id")], offset=100, limit=50).select("event_id", "user_id", "event_type")


@query(
    "clause_hierarchy",
    """WITH {blocks} SELECT block_id, clause_id FROM blocks WHERE clause_id = '3.2.1' OR clause_id LIKE '3.2.1.%' OR '3.2.1' LIKE clause_id || '.%' OR clause_id = '4.1' OR clause_id LIKE '4.1.%' OR '4.1' LIKE clause_id || '.%'""",
)
def clause_hierarchy(t: Tables) -> DataFrame:
    hit = fn.related_clause(F.col("clause_id"), F.lit("3.2.1")) | fn.related_clause(F.col("clause_id"), F.lit("4.1"))
    return t.blocks.where(hit).select("block_id", "clause_id")


@query(
    "exact_clause",
    r"""WITH {blocks} SELECT block_id FROM blocks WHERE regexp_matches('see ' || clause_id || ' there', '(^|[^0-9.])3\.2\.1([^0-9.]|$)')""",
)
def exact_clause(t: Tables) -> DataFrame:
    rows = t.blocks.withColumn("text", F.concat(F.lit("see "), "clause_id", F.lit(" there")))
    return listing.with_exact_clause(rows, "3.2.1").select("block_id")


@query(
    "metadata_filter",
    """WITH {blocks}, rows AS (SELECT block_id, page_idx, block_type || ' / ' || (pos % 4) AS section_path, [block_type, 'p' || (pos % 3)] AS tags FROM blocks)
       SELECT block_id FROM rows WHERE contains(section_path, 'list_item') AND page_idx BETWEEN 1 AND 3 AND list_has_any(tags, ['p1', 'formula'])""",
)
def metadata_filter(t: Tables) -> DataFrame:
    rows = t.blocks.select("block_id", "page_idx", F.concat_ws(" / ", "block_type", F.col("pos") % 4).alias("section_path"), F.array("block_type").alias("entity_tags"), F.array(F.concat(F.lit("p"), F.col("pos") % 3)).alias("conditions"))
    return listing.metadata_filter(rows, section="list_item", first_page=1, last_page=3, tags=["p1", "formula", " "], tag_columns=["entity_tags", "conditions"]).select("block_id")


@query("token_search", "WITH {blocks} SELECT block_id FROM blocks WHERE contains(lower(text), 'ththe') OR contains(lower(text), 'leaux') OR contains(lower(block_type), 'formula')")
def token_search(t: Tables) -> DataFrame:
    return listing.any_token(t.blocks, ["ththe", "leaux", "formula"], "text", "block_type").select("block_id")


@query(
    "document_aggregate",
    """SELECT d.doc_id, (SELECT count(*) FROM labels l WHERE l.doc_id = d.doc_id) AS n_labels, coalesce((SELECT string_agg(l.quality || '/' || l.toxic, ',' ORDER BY l.quality, l.toxic) FROM labels l WHERE l.doc_id = d.doc_id), '') AS labels FROM documents d""",
)
def document_aggregate(t: Tables) -> DataFrame:
    whole = listing.nested(t.documents.select("doc_id"), "doc_id", labels=t.labels)
    return whole.select("doc_id", F.size("labels").cast("long").alias("n_labels"), F.array_join(F.transform("labels", lambda x: F.concat_ws("/", x["quality"], x["toxic"])), ",").alias("labels"))


@query(
    "block_stats",
    """WITH {blocks} SELECT 'total' AS dimension, NULL AS value, count(*) AS n FROM blocks UNION ALL SELECT 'block_type', block_type, count(*) FROM blocks GROUP BY 2
       UNION ALL SELECT 'title_level', CAST(title_level AS VARCHAR), count(*) FROM blocks GROUP BY 2""",
)
def block_stats(t: Tables) -> DataFrame:
    return stats.counts_by(t.blocks, "block_type", "title_level")


@query("segment_stats", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def segment_stats(t: Tables) -> DataFrame:
    return stats.rolled_up(t.orders, "o_orderstatus", "o_orderpriority")


@query("count_metrics", "SELECT count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def count_metrics(t: Tables) -> DataFrame:
    return stats.scoped_count(t.lineitem, t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")


@query("vector_stats", "SELECT label, count(*) AS n, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim FROM embeddings GROUP BY label")
def vector_stats(t: Tables) -> DataFrame:
    return stats.dimension_stats(t.embeddings, "label", "embedding")


@query("parse_stats", "SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_type IN ('purchase', 'click') GROUP BY 1, 2")
def parse_stats(t: Tables) -> DataFrame:
    return stats.period_stats(t.events.where("event_type IN ('purchase', 'click')"), F.col("ts"), "user_id", "value").withColumn("total", F.round("total", 4)).withColumn("day", F.col("day").cast("string"))


@query("page_counts", "WITH {blocks} SELECT doc_id, max(page_idx) + 1 AS pages FROM blocks WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY doc_id")
def page_counts(t: Tables) -> DataFrame:
    return listing.page_counts(t.blocks, t.labels.where("quality = 1"))


@query(
    "eval_summary",
    """WITH runs AS (SELECT d.doc_id, lang, source, quality::DOUBLE AS score, [lang, 'q' || toxic] AS flags FROM documents d JOIN labels USING (doc_id)),
       pairs AS (SELECT 'lang' AS dimension, lang AS value, score FROM runs UNION ALL SELECT 'source', source, score FROM runs UNION ALL SELECT 'flags', unnest(flags), score FROM runs)
       SELECT dimension, value, count(*) AS n, round(avg(score), 6) AS mean_score FROM pairs GROUP BY 1, 2""",
)
def eval_summary(t: Tables) -> DataFrame:
    runs = t.documents.join(t.labels, "doc_id").select("lang", "source", F.col("quality").cast("double").alias("score"), F.array("lang", F.concat(F.lit("q"), "toxic")).alias("flags"))
    return stats.grouped_scores(runs, ["lang", "source", "flags"], "score").withColumn("mean_score", F.round("mean_score", 6))


@query(
    "table_features",
    r"""WITH matrices AS (SELECT p_size % 10 AS table_id, list([p_brand, CAST(p_size AS VARCHAR), CAST(p_retailprice AS VARCHAR), p_name] ORDER BY p_partkey) AS rows FROM part GROUP BY 1),
       cells AS (SELECT table_id, [trim(c) for c in flatten(rows) if trim(c) <> ''] AS cells, [trim(r[1]) for r in rows] AS first FROM matrices),
       feats AS (SELECT table_id, len([c for c in cells if regexp_full_match(c, '[0-9.+\-%/,:() ]+')]) / len(cells) AS numeric_ratio, list_sum([length(c) for c in cells]) / len(cells) AS avg_cell_length,
              len([c for c in cells if length(c) >= 20]) / len(cells) AS long_text_cell_ratio, len(list_distinct(first)) / len(first) AS first_col_uniqueness FROM cells)
       SELECT table_id, round(numeric_ratio, 6) AS numeric_ratio, round(avg_cell_length, 6) AS avg_cell_length, round(long_text_cell_ratio, 6) AS long_text_cell_ratio, round(first_col_uniqueness, 6) AS first_col_uniqueness,
              CASE WHEN long_text_cell_ratio >= 0.3 AND numeric_ratio < 0.4 THEN 'text_dense' WHEN numeric_ratio >= 0.6 AND long_text_cell_ratio <= 0.1 THEN 'numeric_dense'
                   WHEN first_col_uniqueness >= 0.8 AND long_text_cell_ratio BETWEEN 0.05 AND 0.4 AND numeric_ratio <= 0.5 THEN 'mapping_enum' ELSE 'hybrid' END AS table_type FROM feats""",
)
def table_features(t: Tables) -> DataFrame:
    row = F.array("p_brand", F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"), "p_name")
    matrices = t.part.groupBy((F.col("p_size") % 10).alias("table_id")).agg(F.collect_list(row).alias("rows"))
    found = matrices.select("table_id", stats.table_features(F.col("rows")).alias("f"))
    names = ["numeric_ratio", "avg_cell_length", "long_text_cell_ratio", "first_col_uniqueness"]
    return found.select("table_id", *(F.round(f"f.{n}", 6).alias(n) for n in names), stats.table_kind(F.col("f")).alias("table_type"))


@query(
    "text_functions",
    r"""WITH {blocks}, rows AS (SELECT block_id, block_type, clause_id || ' ' || text AS line, trim(regexp_replace(clause_id || ' ' || text, '\s+', ' ', 'g')) AS plain, title_level FROM blocks)
       SELECT block_id, plain AS clean, CASE WHEN plain = '' THEN 0 ELSE greatest(1, length(plain) // 4) END AS tokens, nullif(regexp_extract(plain, '^(\d+(?:\.\d+){1,4})\s', 1), '') AS clause,
              coalesce(title_level, CASE WHEN regexp_matches(plain, '^\d+\.\d+\.\d+') THEN 3 ELSE 1 END) AS level, block_type AS kind FROM rows""",
)
def text_functions(t: Tables) -> DataFrame:
    line = F.concat_ws(" ", "clause_id", "text")
    return t.blocks.select(
        "block_id", fn.clean(line).alias("clean"), fn.token_count(line).cast("long").alias("tokens"), fn.clause_id(line).alias("clause"), fn.title_level(line, F.col("title_level")).cast("long").alias("level"), fn.block_type(F.col("block_type")).alias("kind")
    )


@query(
    "match_form",
    r"""SELECT doc_id, lower(regexp_replace(regexp_replace(text, '\s+', '', 'g'), '[，。；：、“”‘’（）()\[\]【】《》{}<>.,;:!?！？·—\-~$\\]', '', 'g')) AS form FROM documents""",
)
def match_form(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", fn.match_form(F.col("text")).alias("form"))


@query(
    "number_ranges",
    """SELECT p_partkey, CAST(p_size AS DOUBLE) AS lo, CASE WHEN p_size % 2 = 0 THEN CAST(p_size + 5 AS DOUBLE) END AS hi FROM part""",
)
def number_ranges(t: Tables) -> DataFrame:
    written = F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_size"), F.lit(" ~ "), F.col("p_size") + 5)).otherwise(F.concat(F.lit("≥"), "p_size"))
    return t.part.select("p_partkey", fn.number_range(written).alias("r")).select("p_partkey", "r.lo", "r.hi")


@query(
    "section_forms",
    """WITH rows AS (SELECT c_custkey, ' A' || (c_custkey % 7) || ' //' || c_mktsegment || '/  ' AS path FROM customer)
       SELECT c_custkey, array_to_string([trim(p) for p in string_split(path, '/') if trim(p) <> ''], ' / ') AS path, list_last([trim(p) for p in string_split(path, '/') if trim(p) <> '']) AS chapter FROM rows""",
)
def section_forms(t: Tables) -> DataFrame:
    path = F.concat(F.lit(" A"), F.col("c_custkey") % 7, F.lit(" //"), "c_mktsegment", F.lit("/  "))
    return t.customer.select("c_custkey", fn.section_form(path).alias("path"), fn.chapter(path).alias("chapter"))
