"""Alignment, edits, table and formula routes, reviews, seeds and counting questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.query import Question
from folioscope.functions.text import entity_form, let, match_form, similarity, year_of
from folioscope.operators import alignment, edits, listing, search, stats, text2sql
from folioscope.plans.registry import Tables, query
from folioscope.session import work_dir
from folioscope.sources import readers

BOXES = "SELECT *, (pos % 5) / 10 AS x0, (pos % 20) / 20 AS y0, (pos % 5) / 10 + 0.5 AS x1, (pos % 20) / 20 + 0.05 AS y1 FROM blocks"


def boxed(t: Tables) -> DataFrame:
    return t.blocks.select("*", (F.col("pos") % 5 / 10).alias("x0"), (F.col("pos") % 20 / 20).alias("y0"), (F.col("pos") % 5 / 10 + 0.5).alias("x1"), (F.col("pos") % 20 / 20 + 0.05).alias("y1"))


@query(
    "positional_alignment",
    f"""WITH {{blocks}}, b AS ({BOXES}), l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS ordinal FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS ordinal FROM b WHERE pos % 10 <> 9)
        SELECT coalesce(l.doc_id, r.doc_id) AS doc_id, coalesce(l.ordinal, r.ordinal) AS ordinal, l.block_id AS left_id, r.block_id AS right_id, coalesce(l.page_idx = r.page_idx AND l.x0 = r.x0 AND l.y0 = r.y0, FALSE) AS agrees FROM l FULL JOIN r ON l.doc_id = r.doc_id AND l.ordinal = r.ordinal""",
)
def positional_alignment(t: Tables) -> DataFrame:
    return alignment.aligned(boxed(t), boxed(t).where("pos % 10 <> 9"))


@query(
    "nearest_centres",
    f"""WITH {{blocks}}, b AS ({BOXES}), p AS (SELECT a.block_id, b.block_id AS other_id, pow((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2 - 0.01, 2) + pow((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2, 2) AS d FROM b a JOIN b ON b.doc_id = a.doc_id AND b.page_idx = a.page_idx AND b.block_type = 'formula' WHERE a.block_type = 'paragraph')
        SELECT block_id, arg_min(other_id, struct_pack(d := d, o := other_id)) AS other_id FROM p WHERE d <= 0.12 * 0.12 GROUP BY block_id""",
)
def nearest_centres(t: Tables) -> DataFrame:
    shifted = boxed(t).where("block_type = 'formula'").withColumn("x0", F.col("x0") + 0.01).withColumn("x1", F.col("x1") + 0.01)
    return alignment.nearest_centres(boxed(t).where("block_type = 'paragraph'"), shifted, within=0.12)


@query("box_overlap", "SELECT p_partkey, round((10.0 - least(p_size, 10)) * 10 / (200 - (10.0 - least(p_size, 10)) * 10), 6) AS iou FROM part")
def box_overlap(t: Tables) -> DataFrame:
    box = lambda x: F.struct(x.cast("double").alias("x0"), F.lit(0.0).alias("y0"), (x + 10).cast("double").alias("x1"), F.lit(10.0).alias("y1"))
    return t.part.select("p_partkey", F.round(alignment.iou(box(F.lit(0)), box(F.col("p_size"))), 6).alias("iou"))


@query(
    "caption_links",
    """WITH {blocks}, words AS (SELECT *, lower(regexp_replace(text, '[^A-Za-z0-9À-ÿ]', '', 'g')) AS form, lower(regexp_replace(list_last(string_split(trim(text), ' ')), '[^A-Za-z0-9À-ÿ]', '', 'g')) AS needle FROM blocks WHERE regexp_full_match(text, '[A-Za-z ,.]+'))
       SELECT b.block_id, m.block_id AS media_id FROM words b JOIN words m ON b.doc_id = m.doc_id AND b.page_idx = m.page_idx AND m.block_type = 'formula' AND m.needle <> '' AND contains(b.form, m.needle) AND b.block_id <> m.block_id WHERE b.block_type = 'list_item'""",
)
def caption_links(t: Tables) -> DataFrame:
    plain = t.blocks.where(F.col("text").rlike("^[A-Za-z ,.]+$"))
    media = plain.where("block_type = 'formula'").withColumn("needle", F.element_at(F.split(F.trim("text"), " "), -1))
    return alignment.captions(plain.where("block_type = 'list_item'"), media)


@query(
    "split_paragraphs",
    f"""WITH {{blocks}}, b AS ({BOXES}), p AS (SELECT * REPLACE (rtrim(text, '.') AS text) FROM b WHERE block_type = 'paragraph'),
        e AS (SELECT doc_id, page_idx, max_by(block_id, pos) AS lid, max_by(text, pos) AS lt, max_by(y1, pos) AS y1, min_by(block_id, pos) AS fid, min_by(text, pos) AS ft, min_by(y0, pos) AS y0 FROM p GROUP BY 1, 2)
        SELECT a.doc_id, a.page_idx, a.lid AS from_id, c.fid AS to_id, a.lt || c.ft AS text FROM e a JOIN e c ON c.doc_id = a.doc_id AND c.page_idx = a.page_idx + 1 WHERE a.y1 >= 0.8 AND c.y0 <= 0.35 AND NOT regexp_matches(a.lt, '[.。!！?？:：;；]\\s*$')""",
)
def split_paragraphs(t: Tables) -> DataFrame:
    return alignment.split_paragraphs(boxed(t).withColumn("text", F.regexp_replace("text", "\\.+$", "")))


@query("layout_resolution", "WITH {blocks} SELECT block_id, 'c' || block_id AS candidate_id, CASE WHEN pos % 2 = 0 THEN 1.04 ELSE 1.0 END AS score FROM blocks")
def layout_resolution(t: Tables) -> DataFrame:
    """Each block finds its own text among the candidates of its page; the tests compare shared and partial texts."""
    own = t.blocks.withColumn("text", F.concat(F.lit("p"), "pos", F.lit("q"), "text"))
    found = own.withColumn("candidate_id", F.concat(F.lit("c"), "block_id")).withColumn("block_type", F.when(F.col("pos") % 2 == 0, F.col("block_type")).otherwise("other"))
    return alignment.resolved_boxes(own, found)


@query("page_labels", "WITH {blocks} SELECT doc_id, page_idx, CAST(page_idx + 1 AS VARCHAR) AS label FROM blocks GROUP BY 1, 2 HAVING count(*) FILTER (WHERE pos % 20 = 3) > 0")
def page_labels(t: Tables) -> DataFrame:
    text = F.when(F.col("pos") % 20 == 3, F.concat(F.lit("— "), F.col("page_idx") + 1, F.lit(" —"))).otherwise(F.concat(F.lit("x "), F.col("text")))
    return alignment.page_labels(t.blocks.withColumn("text", text))


TREE = "tree AS (SELECT *, CASE WHEN reading_order > 0 THEN doc_id || ':' || (page_idx * 20) WHEN page_idx > 0 THEN doc_id || ':' || ((page_idx - 1) * 20) END AS parent_id FROM blocks)"


def _tree(t: Tables) -> DataFrame:
    page = lambda n: F.concat_ws(":", "doc_id", n * 20)
    return t.blocks.withColumn("parent_id", F.when(F.col("reading_order") > 0, page(F.col("page_idx"))).when(F.col("page_idx") > 0, page(F.col("page_idx") - 1)))


@query(
    "block_merge",
    f"""WITH {{blocks}}, {TREE}, g AS (SELECT block_id, doc_id || ':' || (pos - 1) AS into_id FROM blocks WHERE pos % 6 = 5)
        SELECT a.block_id, coalesce(g.into_id, a.parent_id) AS parent_id, CASE WHEN b.text IS NULL THEN a.text ELSE a.text || chr(10) || b.text END AS text FROM tree a LEFT JOIN tree b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 AND b.pos % 6 = 5 LEFT JOIN g ON g.block_id = a.parent_id WHERE a.pos % 6 <> 5""",
)
def block_merge(t: Tables) -> DataFrame:
    groups = t.blocks.where("pos % 6 = 5").select("block_id", F.concat_ws(":", "doc_id", F.col("pos") - 1).alias("into_id"))
    return edits.merged(_tree(t), groups).select("block_id", "parent_id", "text")


@query(
    "block_split",
    """WITH {blocks}, p AS (SELECT *, [x for x in string_split(text, '. ') if trim(x) <> ''] AS parts FROM blocks)
       SELECT block_id || CASE WHEN n > 0 THEN '-' || (n + 1) ELSE '' END AS block_id, piece AS text FROM (SELECT block_id, unnest(range(len(parts))) AS n, unnest(parts) AS piece FROM p WHERE pos % 3 = 0 AND len(parts) >= 2) UNION ALL SELECT block_id, text FROM p WHERE pos % 3 <> 0 OR len(parts) < 2""",
)
def block_split(t: Tables) -> DataFrame:
    pieces = t.blocks.where("pos % 3 = 0").select("block_id", F.split("text", "\\. ").alias("texts"))
    return edits.split(t.blocks, pieces).select("block_id", "text")


@query(
    "block_delete",
    f"""WITH RECURSIVE {{blocks}}, {TREE}, gone AS (SELECT block_id FROM blocks WHERE pos % 40 = 20 OR pos % 9 = 4), up AS (SELECT block_id, parent_id FROM tree WHERE block_id NOT IN (SELECT block_id FROM gone)
        UNION ALL SELECT u.block_id, t.parent_id FROM up u JOIN tree t ON t.block_id = u.parent_id WHERE u.parent_id IN (SELECT block_id FROM gone))
        SELECT block_id, parent_id FROM up WHERE parent_id IS NULL OR parent_id NOT IN (SELECT block_id FROM gone)""",
)
def block_delete(t: Tables) -> DataFrame:
    return edits.deleted(_tree(t), t.blocks.where("pos % 40 = 20 OR pos % 9 = 4").select("block_id")).select("block_id", "parent_id")


@query("title_relevel", "WITH {blocks} SELECT block_id, CASE WHEN block_id IN ('0:0', '1:0') THEN least(6, title_level + 2) ELSE title_level END AS title_level FROM blocks WHERE block_type = 'title'")
def title_relevel(t: Tables) -> DataFrame:
    return edits.relevelled(t.blocks.where("block_type = 'title'"), ["0:0", "1:0"], by=2).select("block_id", F.col("title_level").cast("long").alias("title_level"))


@query(
    "link_validation",
    """WITH {blocks}, l AS (SELECT block_id AS source_id, doc_id || ':' || (pos + CASE WHEN pos % 4 = 0 THEN 30 WHEN pos % 4 = 1 THEN -1 ELSE 2 END) AS target_id FROM blocks WHERE pos % 5 = 0), r AS (SELECT *, sum(CASE WHEN block_type = 'title' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS titles FROM blocks)
       SELECT * FROM (SELECT source_id, target_id, CASE WHEN s.block_id IS NULL OR t.block_id IS NULL THEN 'missing' WHEN t.pos <= s.pos THEN 'not later' WHEN t.titles - s.titles - CASE WHEN t.block_type = 'title' THEN 1 ELSE 0 END > 0 THEN 'title between' END AS problem FROM l LEFT JOIN r s ON s.block_id = source_id LEFT JOIN r t ON t.block_id = target_id) WHERE problem IS NOT NULL""",
)
def link_validation(t: Tables) -> DataFrame:
    step = F.when(F.col("pos") % 4 == 0, 30).when(F.col("pos") % 4 == 1, -1).otherwise(2)
    links = t.blocks.where("pos % 5 = 0").select(F.col("block_id").alias("source_id"), F.concat_ws(":", "doc_id", F.col("pos") + step).alias("target_id"))
    return edits.invalid_links(t.blocks, links)


@query("review_transitions", "SELECT c_custkey AS entity_id, coalesce(max_by(CASE WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'rejected' END, o_orderkey), 'pending') AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def review_transitions(t: Tables) -> DataFrame:
    decisions = t.orders.select(F.col("o_custkey").alias("entity_id"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("rejected").alias("status"), F.col("o_orderkey").alias("at"))
    return edits.reviewed(t.customer.select(F.col("c_custkey").alias("entity_id"), F.lit("pending").alias("status")), decisions)


@query(
    "entity_reuse",
    """WITH e AS (SELECT s_suppkey AS entity_id, 'S ' || md5(CAST(s_suppkey AS VARCHAR)) AS name, 'S' || s_suppkey AS alias FROM supplier),
       n AS (SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN 'S ' || md5(CAST(c_custkey AS VARCHAR)) WHEN 1 THEN 'S' || c_custkey WHEN 2 THEN 's  ' || upper(md5(CAST(c_custkey AS VARCHAR))) ELSE 'S ' || substr(md5(CAST(c_custkey AS VARCHAR)), 2) END AS name FROM customer),
       m AS (SELECT n.name, entity_id, 1 AS r FROM n JOIN e USING (name) UNION ALL SELECT n.name, entity_id, 2 FROM n JOIN e ON n.name = alias UNION ALL SELECT n.name, entity_id, 3 FROM n JOIN e ON lower(replace(n.name, ' ', '')) = lower(replace(e.name, ' ', '')) UNION ALL SELECT n.name, entity_id, 4 FROM n JOIN e ON n.name = 'S ' || substr(e.name, 4))
       SELECT name, arg_min(entity_id, struct_pack(r := r, e := entity_id)) AS entity_id, CASE min(r) WHEN 1 THEN 'exact' WHEN 2 THEN 'alias' WHEN 3 THEN 'form' ELSE 'similar' END AS method FROM m GROUP BY name""",
)
def entity_reuse(t: Tables) -> DataFrame:
    """Names that are known, known aliases, known forms, and names that lack a letter of a known one."""
    key, digest = F.col("c_custkey"), F.md5(F.col("c_custkey").cast("string"))
    name = F.when(key % 4 == 0, F.concat(F.lit("S "), digest)).when(key % 4 == 1, F.concat(F.lit("S"), key)).when(key % 4 == 2, F.concat(F.lit("s  "), F.upper(digest))).otherwise(F.concat(F.lit("S "), F.substring(digest, 2, 32)))
    entities = t.supplier.select(F.col("s_suppkey").alias("entity_id"), F.concat(F.lit("S "), F.md5(F.col("s_suppkey").cast("string"))).alias("name"), F.array(F.concat(F.lit("S"), "s_suppkey")).alias("aliases"))
    return edits.reuse(t.customer.select(name.alias("name")).distinct(), entities, entity_form(F.col("name")), entity_form(F.col("name")))


@query(
    "title_level_decisions",
    """SELECT c_custkey, CAST(CASE WHEN c_custkey % 3 > 0 AND c_custkey % 10 / 10 < 0.8 THEN c_custkey % 3 ELSE coalesce(nullif(c_custkey % 4, 0), nullif(c_custkey % 3, 0), 0) END AS BIGINT) AS level,
              CASE WHEN c_custkey % 3 = 0 AND c_custkey % 4 = 0 THEN 'review' WHEN c_custkey % 3 = c_custkey % 4 OR c_custkey % 3 = 0 OR c_custkey % 4 = 0 THEN 'adopt' WHEN c_custkey % 10 / 10 >= 0.8 THEN 'disputed' ELSE 'review' END AS decision FROM customer""",
)
def title_level_decisions(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    told = edits.level_decision(F.nullif(key % 3, F.lit(0)), F.nullif(key % 4, F.lit(0)), key % 10 / 10)
    return t.customer.select("c_custkey", told.alias("d")).select("c_custkey", F.coalesce("d.level", F.lit(0)).alias("level"), "d.decision")


@query("text2sql_count", "SELECT COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def text2sql_count(t: Tables) -> DataFrame:
    return text2sql.run({"orders": t.orders}, text2sql.count_statement("orders", {"o_orderstatus": "F"}), {"orders": ["o_orderstatus", "o_custkey"]})


@query(
    "staleness",
    """WITH d AS (SELECT p_partkey, p_brand AS family, 1990 + p_size AS year FROM part) SELECT p_partkey, year FROM d WHERE year < (SELECT max(year) FROM d e WHERE e.family = d.family)""",
)
def staleness(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.col("p_brand").alias("family"), year_of(F.concat(F.lit("JTS 165-"), F.col("p_size") + 1990)).cast("long").alias("year"))
    return stats.outdated(rows, "family", "year").select("p_partkey", "year")


@query("nodes_and_folders", "SELECT 'd' || doc_id AS id, source AS parent_id, 'document' AS kind FROM documents UNION ALL SELECT DISTINCT source, NULL, 'folder' FROM documents")
def nodes_and_folders(t: Tables) -> DataFrame:
    return listing.nodes_and_folders(t.documents.select("doc_id", F.col("source").alias("folder")))


@query(
    "markdown_sections",
    """WITH {blocks}, t AS (SELECT *, CAST(sum(CASE WHEN block_type = 'title' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS n FROM blocks)
       SELECT doc_id, n, max(CASE WHEN block_type = 'title' THEN text END) AS heading, count(*) - 1 AS lines FROM t WHERE text <> '' GROUP BY doc_id, n HAVING max(CASE WHEN block_type = 'title' THEN text END) IS NOT NULL""",
)
def markdown_sections(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("pos")
    rows = t.blocks.withColumn("n", F.sum((F.col("block_type") == "title").cast("int")).over(order)).where("text <> ''")
    out = rows.groupBy("doc_id", "n").agg(F.max(F.when(F.col("block_type") == "title", F.col("text"))).alias("heading"), (F.count("*") - 1).alias("lines"))
    return out.where("heading IS NOT NULL")


TABLE_Q = Question("red widget price 28", task="table_qa")


@query(
    "table_row_candidates",
    r"""WITH r AS (SELECT p_partkey, lower(p_name) AS key, lower(regexp_replace(p_brand || chr(10) || p_name || ' ' || p_size, '[\s#]', '', 'g')) AS form, p_name, p_size FROM part),
        s AS (SELECT p_partkey, key, CASE WHEN contains(form, 'red') THEN 1.5 ELSE 0 END + CASE WHEN contains(form, 'widget') THEN 1.5 ELSE 0 END + CASE WHEN contains(form, 'price') THEN 1.5 ELSE 0 END + CASE WHEN contains(form, '28') THEN 1 ELSE 0 END AS score,
              CASE WHEN contains(key, 'red') OR contains(key, 'widget') OR contains(key, 'price') THEN 1.6 ELSE 0 END AS bonus FROM r)
        SELECT p_partkey, round(score + bonus, 6) AS score FROM s WHERE score + bonus > 0 ORDER BY score + bonus DESC, p_partkey LIMIT 20""",
)
def table_row_candidates(t: Tables) -> DataFrame:
    text = F.regexp_replace(F.concat_ws(" ", "p_name", "p_size"), "#", "")
    base = search.sparse_score(F.regexp_replace("p_brand", "#", ""), text, Question("red widget price 28", task="table_qa"))
    bonus = F.when(let(match_form(F.col("p_name")), lambda f: search.lexical_overlap(f, TABLE_Q)) > 0, 1.6).otherwise(0.0)
    return t.part.select("p_partkey", F.round(base + bonus, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "p_partkey").limit(20)


@query("reference_gaps", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND NOT contains(text, 'License')")
def reference_gaps(t: Tables) -> DataFrame:
    answer = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("License"))).otherwise(F.array().cast("array<string>"))
    return t.documents.where(F.exists(answer, lambda r: ~F.contains("text", r))).select("doc_id")


@query(
    "question_clusters",
    """SELECT signature, max(n) AS n, string_agg(doc_id, ',' ORDER BY doc_id) AS first FROM (SELECT *, count(*) OVER (PARTITION BY signature) AS n, row_number() OVER (PARTITION BY signature ORDER BY length(text) DESC, doc_id) AS rank
       FROM (SELECT doc_id, text, lang || '-' || (n_chars // 1000) AS signature FROM documents)) WHERE rank <= 3 GROUP BY signature""",
)
def question_clusters(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.char_length("text").alias("size"), F.concat_ws("-", "lang", F.floor(F.col("n_chars") / 1000)).alias("signature"))
    return stats.clusters(rows, "signature", "doc_id", "size", shown=3).select("signature", "n", F.array_join("first", ",").alias("first"))


@query("fuzzy_names", "SELECT n_nationkey, round(1 - levenshtein(n_name, 'NATION_12') / greatest(length(n_name), 9), 6) AS similarity FROM nation")
def fuzzy_names(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", F.round(similarity(F.col("n_name"), F.lit("NATION_12")), 6).alias("similarity"))


@query("outline_consistency", "WITH {blocks}, o AS (SELECT *, lag(title_level) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM blocks WHERE block_type = 'title') SELECT round(avg(CASE WHEN before IS NULL OR title_level <= before + 1 THEN 1.0 ELSE 0.0 END), 6) AS rate, count(*) AS n FROM o")
def outline_consistency(t: Tables) -> DataFrame:
    return stats.level_consistency(t.blocks.where("block_type = 'title'")).withColumn("rate", F.round("rate", 6))


@query("node_reader", "WITH {blocks} SELECT block_id AS block_uid, block_type, text AS plain_text, page_idx FROM blocks")
def node_reader(t: Tables) -> DataFrame:
    folder = work_dir(t.spark)
    t.blocks.select(F.col("block_id").alias("block_uid"), "block_type", F.col("text").alias("plain_text"), F.col("page_idx").cast("int").alias("page_idx")).write.json(folder)
    return readers.nodes(t.spark, folder).select("block_uid", "block_type", "plain_text", F.col("page_idx").cast("long").alias("page_idx"))
