"""Listings of what a store holds, readers of parsed files, and writes: files are written from the driver's tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators import alignment, edits, evaluate, listing, records, structure, tables
from folioscope.plans.registry import Tables, query
from folioscope.plans.routes import CHUNKS_SQL, TABLES_SQL, chunks, part_tables, targets
from folioscope.session import work_dir
from folioscope.sources import readers, sinks

# ---------------------------------------------------------------- listings


@query("list_chunks", f"WITH {{blocks}}, {CHUNKS_SQL} SELECT chunk_id, page_idx FROM chunks WHERE doc_id = 7 AND contains(lower(text), 'e') ORDER BY page_idx, chunk_id LIMIT 1000")
def list_chunks(t: Tables) -> DataFrame:
    """Chunks of one document with a keyword."""
    return listing.listing(chunks(t), where=F.col("doc_id") == 7, kinds=["content"], kind="chunk_type", keyword="E", order=["page_idx", "chunk_id"], limit=5000).select("chunk_id", "page_idx")


@query("list_tables", f"WITH {TABLES_SQL} SELECT table_id FROM tables WHERE t IN (0, 3) AND (contains(lower(title), '1') OR contains(lower(caption), '1') OR contains(lower(summary), '1')) ORDER BY table_id LIMIT 500")
def list_tables(t: Tables) -> DataFrame:
    return listing.listing(part_tables(t)[0], kinds=["numeric_dense", "hybrid"], kind="table_type", keyword="1", columns=["title", "caption", "summary"], order=["table_id"], limit=900, most=500).select("table_id")


@query(
    "list_targets",
    r"""WITH {blocks}, x AS (SELECT block_id AS target_id, block_type AS target_type, page_idx, doc_id FROM blocks WHERE block_type IN ('title', 'formula'))
        (SELECT target_id, target_type FROM x WHERE doc_id = 7 ORDER BY page_idx, target_id LIMIT 200) UNION ALL SELECT target_id, 'looked up' FROM x WHERE doc_id = 7 AND target_id = '7:0'""",
)
def list_targets(t: Tables) -> DataFrame:
    """Citation targets of a document, and one of them by its id."""
    own = targets(t).where("doc_id = 7")
    all_ = listing.listing(own, order=["page_idx", "target_id"], limit=200).select("target_id", "target_type")
    return all_.unionByName(own.where("target_id = '7:0'").limit(1).select("target_id", F.lit("looked up").alias("target_type")))


@query(
    "list_segments",
    """SELECT o_orderkey AS segment_id, o_orderpriority AS item_type FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND contains(lower(o_orderpriority), 'ur') ORDER BY o_orderdate, o_orderkey LIMIT 300""",
)
def list_segments(t: Tables) -> DataFrame:
    """Segments of one strategy and some item types with a keyword, in their order."""
    return listing.listing(t.orders, where=F.col("o_orderstatus") == "F", kinds=["1-URGENT", "2-HIGH"], kind="o_orderpriority", keyword="UR", columns=["o_orderpriority"], order=["o_orderdate", "o_orderkey"], limit=300).select(F.col("o_orderkey").alias("segment_id"), F.col("o_orderpriority").alias("item_type"))


@query(
    "document_children",
    """WITH {blocks} SELECT d.doc_id, count(DISTINCT page_idx) AS pages, count(block_id) AS blocks, count(block_id) FILTER (WHERE block_type IN ('title', 'formula')) AS targets, coalesce(min(block_id) FILTER (WHERE pos = 0), '') AS first FROM documents d LEFT JOIN blocks b ON b.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def document_children(t: Tables) -> DataFrame:
    """Documents with their pages, blocks and targets as nested arrays."""
    rows = t.blocks.select("doc_id", "pos", "block_id")
    whole = listing.nested(t.documents.select("doc_id").distinct(), "doc_id", pages=t.blocks.select("doc_id", "page_idx").distinct(), blocks=rows, targets=targets(t).select("doc_id", "target_id"))
    return whole.select("doc_id", *(F.size(c).cast("long").alias(c) for c in ("pages", "blocks", "targets")), F.coalesce(F.get("blocks", F.lit(0))["block_id"], F.lit("")).alias("first"))


@query(
    "rich_media",
    """SELECT p_partkey AS block_id, CASE WHEN p_partkey % 3 = 0 THEN '<table>' ELSE '' END AS table_html, CASE WHEN p_partkey % 2 = 0 THEN p_name || '.png' ELSE '' END AS images FROM part WHERE p_partkey % 5 < 4 AND p_size < 40""",
)
def rich_media(t: Tables) -> DataFrame:
    """Media of the active blocks that are asked for; broken JSON has none."""
    key = F.col("p_partkey")
    content = F.when(key % 2 == 0, F.to_json(F.struct(F.array(F.concat("p_name", F.lit(".png")), F.lit("")).alias("image_paths")))).otherwise("{broken")
    rows = t.part.select(key.alias("block_id"), (key % 5 < 4).alias("is_active"), F.when(key % 3 == 0, "<table>").alias("table_html"), F.lit(None).cast("string").alias("math_content"), F.lit(None).cast("string").alias("image_path"), content.alias("content_json"))
    found = structure.rich_media(rows, t.part.where("p_size < 40").select(key.alias("block_id")))
    return found.select("block_id", "table_html", F.array_join("image_paths", ",").alias("images"))


@query("label_lookup", "WITH {blocks} SELECT block_id, CASE WHEN page_idx % 2 = 0 THEN 'p. ' || (page_idx + 1) ELSE '' END AS label FROM blocks")
def label_lookup(t: Tables) -> DataFrame:
    """Blocks with the printed label of their page, where it has one."""
    labels = t.blocks.where("page_idx % 2 = 0").select("doc_id", "page_idx", F.concat(F.lit("p. "), F.col("page_idx") + 1).alias("label"))
    return listing.with_labels(t.blocks, labels).select("block_id", "label")


# ---------------------------------------------------------------- readers


@query(
    "bundle_reader",
    """SELECT 'set-' || p_brand AS dataset_id, p_partkey || '' AS question_id, p_name AS question, 'S ' || p_size AS gold, 'contains_all:' || p_type AS checks FROM part""",
)
def bundle_reader(t: Tables) -> DataFrame:
    """Evaluation bundles with a schema version, a question per part, written as JSON and read back."""
    check = F.struct(F.lit("contains_all").alias("type"), F.array("p_type").alias("keywords"))
    item = F.struct(F.col("p_partkey").cast("string").alias("question_id"), F.col("p_name").alias("question"), F.struct(F.array(F.concat(F.lit("S "), "p_size")).alias("gold_section_paths")).alias("retrieval"), F.struct(F.array(check).alias("correctness_checks")).alias("answer"))
    head = F.struct(F.concat(F.lit("set-"), "p_brand").alias("dataset_id"), F.lit("eval.bundle.v2").alias("schema_version"))
    folder = work_dir(t.spark)
    t.part.select(head.alias("dataset"), F.array(item).alias("items")).write.json(folder)
    found = readers.questions(t.spark, folder, lines=True)
    checks = F.transform("answer.correctness_checks", lambda c: F.concat_ws(":", c["type"], F.array_join(c["keywords"], ",")))
    return found.select("dataset_id", "question_id", "question", F.array_join("retrieval.gold_section_paths", ",").alias("gold"), F.array_join(checks, ";").alias("checks"))


@query("catalogue_reader", "SELECT p_partkey || '' AS sop_id, place, 'step ' || place AS name, CASE WHEN place = 0 THEN 'calculator' ELSE 'auto' END AS tool FROM part, (SELECT unnest([0, 1]) AS place) WHERE p_size % 2 = 0")
def catalogue_reader(t: Tables) -> DataFrame:
    """Procedures of one status with their steps in order, written as JSON and read back."""
    step = lambda n, tool: F.struct(F.lit(f"s{n}").alias("step_id"), F.lit(f"step {n}").alias("name"), F.lit(tool).alias("tool"))
    folder = work_dir(t.spark)
    t.part.select(F.col("p_partkey").cast("string").alias("sop_id"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 2 == 0, "approved").otherwise("draft").alias("status"), F.array(step(0, "calculator"), step(1, "auto")).alias("steps")).write.json(folder)
    return readers.steps(t.spark, folder, status="approved", lines=True).select("sop_id", F.col("place").cast("long").alias("place"), "name", "tool")


@query("layout_reader", "SELECT p_partkey AS page_idx, round(p_size / 100, 6) AS x0, 1.0 AS x1, 'text' AS label, 0.9 AS score FROM part WHERE p_partkey % 3 > 0")
def layout_reader(t: Tables) -> DataFrame:
    """Boxes of a layout model, relative to their pages and cut at the edge; boxes without a score and pages without a size don't count."""
    key = F.col("p_partkey")
    det = F.struct(F.lit(" text ").alias("label"), F.lit(0.9).alias("score"), F.array(F.col("p_size").cast("double"), F.lit(0.0), F.lit(250.0), F.lit(9.0)).alias("bbox"))
    bare = F.struct(F.lit("text").alias("label"), F.lit(None).cast("double").alias("score"), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("bbox"))
    page = F.struct(key.cast("int").alias("page_no"), F.when(key % 3 == 0, 0.0).otherwise(100.0).alias("width"), F.lit(200.0).alias("height"))
    folder = work_dir(t.spark)
    t.part.select(page.alias("page_info"), F.array(det, bare).alias("layout_dets")).write.json(folder)
    return readers.model_boxes(t.spark, folder, lines=True).select(F.col("page_idx").cast("long").alias("page_idx"), F.round("x0", 6).alias("x0"), "x1", "label", "score")


@query("recognition_scores", "SELECT p_partkey AS page_idx, 0 AS block, round(p_size / 100, 6) AS score FROM part UNION ALL SELECT p_partkey, 1, NULL FROM part")
def recognition_scores(t: Tables) -> DataFrame:
    """The least score of each block's spans in a parser's intermediate file; a block without spans has none."""
    span = lambda score: F.struct(F.lit("x").alias("content"), score.alias("score"))
    line = F.struct(F.array(span(F.col("p_size") / 100), span(F.lit(0.99))).alias("spans"))
    empty = F.array().cast("array<struct<spans:array<struct<content:string,score:double>>>>")
    page = F.struct(F.col("p_partkey").cast("int").alias("page_idx"), F.array(F.struct(F.lit("text").alias("type"), F.array(line).alias("lines")), F.struct(F.lit("image").alias("type"), empty.alias("lines"))).alias("para_blocks"))
    folder = work_dir(t.spark)
    t.part.select(F.array(page).alias("pdf_info")).write.json(folder)
    found = alignment.recognition_scores(readers.recognised_lines(t.spark, folder, lines=True))
    return found.select(F.col("page_idx").cast("long").alias("page_idx"), F.col("block").cast("long").alias("block"), F.round("score", 6).alias("score"))


@query("content_reader", "SELECT p_size AS page_idx, p_name AS text, count(*) AS n, 'table' AS type FROM part GROUP BY 1, 2")
def content_reader(t: Tables) -> DataFrame:
    """Entries of content lists, a file per part of the table, written as JSON arrays and read back."""
    entry = F.struct(F.lit("table").alias("type"), F.col("p_name").alias("text"), F.col("p_size").cast("int").alias("page_idx"))
    folder = work_dir(t.spark)
    t.part.groupBy("p_brand").agg(F.to_json(F.collect_list(entry)).alias("value")).select("value").write.text(folder)
    found = readers.contents(t.spark, folder, lines=True)
    return found.groupBy(F.col("page_idx").cast("long").alias("page_idx"), "text").agg(F.count("*").alias("n"), F.max("type").alias("type"))


@query("report_sink", "SELECT n_nationkey AS finding, n_name AS text FROM nation")
def report_sink(t: Tables) -> DataFrame:
    """Findings appended to a daily report and read back."""
    folder = work_dir(t.spark)
    sinks.write_report(t.nation.select(F.col("n_nationkey").alias("finding"), F.col("n_name").alias("text")), folder)
    return t.spark.read.schema("finding long, text string").json(folder).select("finding", "text")


# ---------------------------------------------------------------- changes


@query("derived_rows", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS c_name, CASE WHEN c_custkey % 2 = 0 THEN length(c_name) END AS size FROM customer")
def derived_rows(t: Tables) -> DataFrame:
    """Base rows, completed by what a second pass derives for some of them."""
    derived = t.customer.where("c_custkey % 2 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), F.char_length("c_name").cast("long").alias("size"))
    return records.completed(t.customer.select("c_custkey", "c_name"), derived, ["c_custkey"])


@query(
    "reparenting",
    "WITH {blocks} SELECT block_id, CASE WHEN doc_id = 7 AND page_idx = 0 THEN 'other' ELSE doc_id || ':' || (page_idx * 20) END AS parent_id FROM blocks WHERE reading_order > 0",
)
def reparenting(t: Tables) -> DataFrame:
    """All blocks, the children of one block of one document given to another."""
    own = t.blocks.where("reading_order > 0").withColumn("parent_id", F.concat_ws(":", "doc_id", F.col("page_idx") * 20))
    return edits.reparented(own, "7:0", "other").select("block_id", "parent_id")


@query("record_enrichment", "SELECT o_orderkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, 'unknown') AS c_name, n AS pages FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def record_enrichment(t: Tables) -> DataFrame:
    """Records with the names of their senders and the number of their pages."""
    names = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    pages = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("pages"))
    return records.named(t.orders.select("o_orderkey", "o_custkey"), names, "o_custkey", "c_name", unknown="unknown").join(pages, "o_orderkey", "left").select("o_orderkey", "c_name", "pages")


@query(
    "run_counters",
    """SELECT o_custkey AS sop_id, count(*) AS runs, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed, arg_max(CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'done' END, o_orderkey) AS last_status,
              CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) <= 0.1 THEN 'good' WHEN count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) < 0.5 THEN 'fair' ELSE 'poor' END AS health FROM orders GROUP BY o_custkey""",
)
def run_counters(t: Tables) -> DataFrame:
    return records.run_counters(t.orders.select(F.col("o_custkey").alias("sop_id"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("done").alias("status"), F.col("o_orderkey").alias("at")))


@query(
    "current_runs",
    """SELECT run_id FROM (SELECT event_id AS run_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS n FROM events WHERE user_id % 3 = 0) WHERE n <= 4
       UNION ALL SELECT event_id FROM events WHERE user_id % 3 <> 0 AND ts >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)
def current_runs(t: Tables) -> DataFrame:
    """The newest full runs of each kind, and single ones of the last hour."""
    last = t.events.agg(F.max("ts")).first()[0]
    runs = t.events.select(F.col("event_id").alias("run_id"), "event_type", (F.col("user_id") % 3 == 0).alias("full"), "ts")
    return records.current_runs(runs, dataset="event_type", started="ts", keep=4, now=F.lit(last)).select("run_id")


@query("question_details", "SELECT o_orderkey AS question_id, coalesce(nullif(o_orderstatus, 'O'), c_mktsegment) AS task_type, c_name AS title FROM orders LEFT JOIN customer ON c_custkey = o_orderkey")
def question_details(t: Tables) -> DataFrame:
    details = t.orders.select(F.col("o_orderkey").alias("question_id"), F.nullif("o_orderstatus", F.lit("O")).alias("task_type"))
    questions = t.customer.select(F.col("c_custkey").alias("question_id"), F.col("c_mktsegment").alias("task_type"), F.col("c_name").alias("title"))
    return evaluate.enriched(details, questions, "task_type", "title")


@query(
    "json_columns",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || ',b' WHEN 1 THEN 'default' WHEN 2 THEN 'default' ELSE 'default' END AS listed, CASE WHEN p_partkey % 2 = 0 THEN p_size + 2.5 END AS x1 FROM part""",
)
def json_columns(t: Tables) -> DataFrame:
    """Lists from JSON text, with a default for none, broken text and null; boxes to JSON and back, and none from what is no box."""
    key = F.col("p_partkey")
    text = F.when(key % 4 == 0, F.to_json(F.array("p_name", F.lit("b")))).when(key % 4 == 1, "{broken").when(key % 4 == 2, "null")
    size = F.col("p_size").cast("double")
    box = F.struct(size.alias("x0"), F.lit(0.0).alias("y0"), (size + 2.5).alias("x1"), F.lit(1.0).alias("y1"))
    told = F.when(key % 2 == 0, structure.box_json(box)).otherwise('{"x0": 1}')
    return t.part.select("p_partkey", F.array_join(structure.json_or(text, "array<string>", F.array(F.lit("default"))), ",").alias("listed"), structure.json_box(told)["x1"].alias("x1"))


@query(
    "graph_adapter",
    """WITH {blocks} SELECT doc_id, CASE WHEN pos % 3 = 0 THEN 'graph-block-' || pos ELSE block_id END AS block_id, CASE WHEN block_type = 'formula' THEN 'formula' WHEN block_type = 'title' THEN 'title' ELSE 'paragraph' END AS block_type, page_idx, CASE WHEN trim(text) = '' THEN '<t>' ELSE trim(text) END AS text FROM blocks""",
)
def graph_adapter(t: Tables) -> DataFrame:
    """Nodes of a graph as blocks."""
    kind = F.when(F.col("block_type") == "formula", "equation_interline").when(F.col("block_type") == "title", "title").otherwise("text")
    rows = t.blocks.select("doc_id", F.when(F.col("pos") % 3 == 0, "").otherwise(F.col("block_id")).alias("block_uid"), kind.alias("block_type"), "page_idx", F.col("reading_order").alias("block_seq"), F.col("text").alias("plain_text"), F.lit("<t>").alias("table_html"), "title_level", F.lit(None).cast("string").alias("parent_block_uid"))
    return structure.adapted(rows).select("doc_id", "block_id", "block_type", "page_idx", "text")


@query(
    "caption_order",
    """WITH {blocks}, m AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY pos) AS k FROM blocks WHERE block_type = 'formula'), c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY pos) AS k FROM blocks WHERE block_type = 'list_item')
       SELECT m.block_id AS media_id, c.block_id AS caption_id FROM m JOIN c ON m.doc_id = c.doc_id AND m.page_idx = c.page_idx AND m.k = c.k""",
)
def caption_order(t: Tables) -> DataFrame:
    rows = t.blocks.select("doc_id", "page_idx", (F.col("reading_order") / 20).alias("y0"), F.col("block_id").alias("id"), "block_type")
    return tables.caption_order(rows.where("block_type = 'formula'"), rows.where("block_type = 'list_item'")).select("media_id", "caption_id")
