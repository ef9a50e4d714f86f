"""Rules that check documents' structure, exports, listings and the three searches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.query import Question
from folioscope.operators import adapters, alignment, edits, evaluate, listing, search, structure
from folioscope.plans import routes
from folioscope.plans.registry import Tables, query
from folioscope.session import work_dir, written
from folioscope.sources import sinks


@query(
    "instruction_checks",
    """WITH {blocks}, b AS (SELECT *, CASE WHEN pos % 13 = 6 THEN 'table' ELSE block_type END AS kind, pos % 2 AS columns, sum(CASE WHEN pos % 13 <> 6 AND block_type = 'title' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS titles FROM blocks),
       i AS (SELECT CASE WHEN pos % 13 = 6 THEN 'table_merge' WHEN pos % 17 = 0 THEN 'other' ELSE 'contd' END AS kind, block_id AS source_uid, doc_id || ':' || (pos + CASE pos % 4 WHEN 0 THEN 13 WHEN 1 THEN -1 WHEN 2 THEN 26 ELSE 1 END) AS target_uid FROM b)
       SELECT i.kind, source_uid, target_uid, reason IS NULL AS accepted, reason FROM (
         SELECT i.kind, source_uid, target_uid, CASE WHEN t.block_id IS NULL THEN 'missing' WHEN i.kind = 'other' THEN 'unknown kind'
            WHEN i.kind = 'contd' THEN CASE WHEN s.kind NOT IN ('paragraph', 'list_item') OR t.kind NOT IN ('paragraph', 'list_item') THEN 'types' WHEN t.pos <= s.pos THEN 'not later' WHEN t.titles > s.titles THEN 'title between' END
            WHEN t.kind <> 'table' THEN 'types' WHEN s.columns <> t.columns THEN 'columns' END AS reason
         FROM i JOIN b s ON s.block_id = source_uid LEFT JOIN b t ON t.block_id = target_uid) i""",
)
def instruction_checks(t: Tables) -> DataFrame:
    """Continuations and table merges between blocks, with what is wrong with them."""
    is_table = F.col("pos") % 13 == 6
    blocks = t.blocks.select("doc_id", "block_id", "pos", F.when(is_table, "table").otherwise(F.col("block_type")).alias("block_type"), "page_idx", F.col("reading_order").alias("block_seq"), (F.col("pos") % 2).alias("columns"))
    kind = F.when(is_table, "table_merge").when(F.col("pos") % 17 == 0, "other").otherwise("contd")
    step = F.when(F.col("pos") % 4 == 0, 13).when(F.col("pos") % 4 == 1, -1).when(F.col("pos") % 4 == 2, 26).otherwise(1)
    instructions = blocks.select(kind.alias("kind"), F.col("block_id").alias("source_uid"), F.concat_ws(":", "doc_id", F.col("pos") + step).alias("target_uid"))
    return edits.checked_instructions(blocks, instructions)


_ENTRIES = """b AS (SELECT doc_id, block_id, page_idx, pos, CASE WHEN block_type = 'list_item' THEN 'list' ELSE block_type END AS kind,
               CASE WHEN doc_id % 3 = 0 AND pos = 5 THEN '目 录' WHEN doc_id % 6 = 0 AND pos = 65 THEN '目次' WHEN doc_id % 2 = 0 AND page_idx IN (1, 3) AND pos % 2 = 0 THEN clause_id || ' a ' || pos WHEN page_idx = 1 AND pos % 3 = 0 THEN 'abcdef …… (' || pos || '）' ELSE text END AS text FROM blocks)"""


@query(
    "contents_rows",
    rf"""WITH {{blocks}}, {_ENTRIES}, told AS (
         SELECT *, regexp_replace(text, '\s+', '', 'g') AS plain, kind IN ('title', 'list', 'paragraph') AS typed FROM b),
       judged AS (
         SELECT *, plain IN ('目录', '目次') AS name, plain IN ('目录', '目次') OR (regexp_matches(plain, '[(（]?[0-9]{{1,4}}[)）]?$') AND (regexp_matches(plain, '^(附录[A-Z]|附录|引用标准名录|条文说明|[0-9]+([.\-][0-9]+)*)') OR (regexp_matches(plain, '…|\.\.\.') AND length(plain) >= 8))) AS entry FROM told),
       pages AS (
         SELECT doc_id, page_idx, bool_or(name) AS named, count(*) FILTER (typed) AS texts, count(*) FILTER (typed AND entry) AS entries FROM judged GROUP BY doc_id, page_idx),
       held AS (
         SELECT doc_id, page_idx FROM (SELECT *, bool_and(named OR page_idx < first OR (texts > 0 AND (entries >= 2 OR (texts >= 2 AND entries / texts >= 0.45)))) OVER (PARTITION BY doc_id ORDER BY page_idx) AS held_on FROM (SELECT *, min(page_idx) FILTER (named) OVER (PARTITION BY doc_id) AS first FROM pages))
         WHERE named OR (page_idx >= first AND held_on))
       SELECT doc_id, block_id FROM judged JOIN held USING (doc_id, page_idx) WHERE typed AND trim(text) <> ''""",
)
def contents_rows(t: Tables) -> DataFrame:
    """Blocks of contents pages, which begin with a page of that name."""
    key, pos, page = F.col("doc_id"), F.col("pos"), F.col("page_idx")
    text = (
        F.when((key % 3 == 0) & (pos == 5), "目 录")
        .when((key % 6 == 0) & (pos == 65), "目次")
        .when((key % 2 == 0) & page.isin(1, 3) & (pos % 2 == 0), F.concat("clause_id", F.lit(" a "), pos.cast("string")))
        .when((page == 1) & (pos % 3 == 0), F.concat(F.lit("abcdef …… ("), pos.cast("string"), F.lit("）")))
        .otherwise(F.col("text"))
    )
    kind = F.when(F.col("block_type") == "list_item", "list").otherwise(F.col("block_type"))
    return structure.contents_rows(t.blocks.select("doc_id", "block_id", "page_idx", kind.alias("block_type"), text.alias("text")))


@query(
    "media_related",
    """WITH {blocks}, m AS (SELECT doc_id, page_idx, block_id AS media_id, pos FROM blocks WHERE block_type = 'formula'),
       c AS (SELECT *, CASE WHEN pos % 20 = 0 THEN 'title' WHEN pos % 9 = 2 THEN 'Header' ELSE 'paragraph' END AS kind, CASE pos % 3 WHEN 0 THEN 'Figure k' || (pos // 20) || ' shows' WHEN 1 THEN 'note k' || pos ELSE pos || ' heading k' || (pos // 20) END AS own FROM blocks WHERE block_type <> 'formula')
       SELECT media_id, 'caption' AS role, block_id FROM m JOIN c USING (doc_id, page_idx) WHERE kind = 'paragraph' AND c.pos % 3 = 0
       UNION ALL SELECT media_id, 'footnote', block_id FROM m JOIN c USING (doc_id, page_idx) WHERE kind = 'paragraph' AND c.pos % 3 = 1 AND contains('notek' || c.pos, 'k' || m.pos)""",
)
def media_related(t: Tables) -> DataFrame:
    """Captions and footnotes of formulas that stand for images: what begins like their caption, or holds their note's number."""
    page, pos = F.col("page_idx").cast("string"), F.col("pos")
    media = t.blocks.where("block_type = 'formula'").select("doc_id", "page_idx", "block_id", F.array(F.concat(F.lit("Figure k"), page, F.lit(" shows it all")), F.lit("x")).alias("captions"), F.array(F.concat(F.lit("k"), pos.cast("string"))).alias("footnotes"))
    kind = F.when(pos % 20 == 0, "title").when(pos % 9 == 2, "Header").otherwise("paragraph")
    text = F.when(pos % 3 == 0, F.concat(F.lit("Figure k"), page, F.lit(" shows"))).when(pos % 3 == 1, F.concat(F.lit("note k"), pos.cast("string"))).otherwise(F.concat(pos.cast("string"), F.lit(" heading k"), page))
    return alignment.related_blocks(t.blocks.where("block_type <> 'formula'").select("doc_id", "page_idx", "block_id", kind.alias("block_type"), text.alias("text")), media)


@query(
    "document_export",
    """WITH {edges}, r AS (SELECT * FROM edges WHERE doc_id IN ('doc-1', 'doc-3')), b AS (SELECT p_partkey AS note_id, 'supplier-' || (p_partkey % 50) AS entity_id FROM part WHERE p_size % 5 IN (1, 3)),
       e AS (SELECT 'region-' || r_regionkey AS entity_id FROM region UNION ALL SELECT 'nation-' || n_nationkey FROM nation UNION ALL SELECT 'customer-' || c_custkey FROM customer UNION ALL SELECT 'supplier-' || s_suppkey FROM supplier)
       SELECT 'relations' AS name, count(*) AS n, md5(string_agg(source_id, ',' ORDER BY source_id)) AS ids FROM r
       UNION ALL SELECT 'notes', count(*), md5(string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY CAST(p_partkey AS VARCHAR))) FROM part WHERE p_size % 5 IN (1, 3)
       UNION ALL SELECT 'entities', count(*), md5(string_agg(entity_id, ',' ORDER BY entity_id)) FROM e WHERE entity_id IN (SELECT source_id FROM r UNION SELECT target_id FROM r UNION SELECT entity_id FROM b)""",
)
def document_export(t: Tables) -> DataFrame:
    """What is exported for two documents: their relations and notes, and the entities that these name, followed through a bridge."""
    folder = work_dir(t.spark)
    entities = [t.region.selectExpr("concat('region-', r_regionkey) AS entity_id"), t.nation.selectExpr("concat('nation-', n_nationkey) AS entity_id"), t.customer.selectExpr("concat('customer-', c_custkey) AS entity_id"), t.supplier.selectExpr("concat('supplier-', s_suppkey) AS entity_id")]
    notes = t.part.select(F.col("p_partkey").cast("string").alias("note_id"), F.concat(F.lit("doc-"), F.col("p_size") % 5).alias("doc_id"))
    bridge = t.part.select(F.col("p_partkey").cast("string").alias("note_id"), F.concat(F.lit("supplier-"), F.col("p_partkey") % 50).alias("entity_id"))
    tables = {"relations": t.edges, "notes": notes, "note_entities": bridge, "entities": entities[0].union(entities[1]).union(entities[2]).union(entities[3])}
    scope = t.spark.createDataFrame([("doc-1",), ("doc-3",)], "doc_id string")
    sinks.export_documents(tables, scope, "doc_id", folder, relations="relations", entities="entities", bridges={"note_entities": "notes"})
    shown = [t.spark.read.parquet(f"{folder}/{name}").select(F.lit(name).alias("name"), F.col(key).alias("id")) for name, key in (("relations", "source_id"), ("notes", "note_id"), ("entities", "entity_id"))]
    return shown[0].union(shown[1]).union(shown[2]).groupBy("name").agg(F.count("*").alias("n"), F.md5(F.array_join(F.sort_array(F.collect_list("id")), ",")).alias("ids"))


@query("list_libraries", "SELECT library_id, name, tasks, done FROM (SELECT n_nationkey AS library_id, n_name AS name, count(c_custkey) AS tasks, count(c_custkey) FILTER (c_acctbal >= 0) AS done FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2) ORDER BY name, library_id LIMIT 20")
def list_libraries(t: Tables) -> DataFrame:
    """Libraries by name, with their tasks."""
    tasks = t.customer.groupBy(F.col("c_nationkey").alias("library_id")).agg(F.count("*").alias("tasks"), F.count_if(F.col("c_acctbal") >= 0).alias("done"))
    rows = t.nation.select(F.col("n_nationkey").alias("library_id"), F.col("n_name").alias("name")).join(tasks, "library_id", "left").fillna(0, ["tasks", "done"])
    return listing.listing(rows.select("library_id", "name", "tasks", "done"), order=["name", "library_id"], limit=20)


@query("list_tasks", "SELECT o_orderkey AS task_id, o_orderstatus AS status FROM orders WHERE o_orderstatus IN ('P', 'O') ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
def list_tasks(t: Tables) -> DataFrame:
    """Tasks that aren't finished, newest first."""
    rows = t.orders.select(F.col("o_orderkey").alias("task_id"), F.col("o_orderstatus").alias("status"), "o_orderdate")
    return listing.listing(rows, kinds=["P", "O"], kind="status", order=[F.desc("o_orderdate"), "task_id"], limit=200).drop("o_orderdate")


@query(
    "evaluator_registry",
    """SELECT 'retrieval' AS evaluator, count(*) AS questions, round(sum(CASE WHEN p_size % 6 < 5 THEN 1.0 ELSE 0 END), 4) AS total FROM part WHERE p_partkey % 4 <> 0
       UNION ALL SELECT 'text2sql', count(*), round(sum(CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0 END), 4) FROM part""",
)
def evaluator_registry(t: Tables) -> DataFrame:
    """Every registered evaluator on questions of its kind, called by its name."""
    place = (F.col("p_size") % 6).cast("int")
    paths = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.when(i == place, "gold").otherwise(F.concat(F.lit("p"), i.cast("string"))))
    gold = F.when(F.col("p_partkey") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("gold")))
    asked = {
        "retrieval": t.part.select(F.col("p_partkey").alias("question_id"), paths.alias("paths"), gold.alias("gold")),
        "text2sql": t.part.select(F.col("p_partkey").alias("question_id"), F.when(F.col("p_size") % 2 == 0, "success").otherwise("error").alias("execution_status"), F.lit("SELECT 1").alias("generated_sql"), F.lit("SELECT 1").alias("expected_sql")),
    }
    parts = [run(asked[name]).select(F.lit(name).alias("evaluator"), "score") for name, run in evaluate.EVALUATORS.items()]
    return parts[0].union(parts[1]).where("score IS NOT NULL").groupBy("evaluator").agg(F.count("*").alias("questions"), F.round(F.sum("score"), 4).alias("total"))


@query(
    "contents_last",
    """WITH rows AS (SELECT CAST(p_partkey AS VARCHAR) AS item, p_retailprice AS score, p_partkey % 3 = 0 OR p_partkey % 5 = 0 AS toc FROM part),
       ranked AS (SELECT item, toc, 'all' AS asked, row_number() OVER (ORDER BY round(score / (SELECT max(score) FROM rows), 6) DESC, item DESC) - 1 AS rank FROM rows
                  UNION ALL SELECT item, toc, 'contents', row_number() OVER (ORDER BY round(score / (SELECT max(score) FROM rows WHERE toc), 6) DESC, item DESC) - 1 FROM rows WHERE toc),
       scored AS (SELECT asked, item AS key, toc, round(1 / (60 + rank) + CASE WHEN toc THEN -0.35 ELSE 0.1 END, 6) AS fusion_score, rank FROM ranked WHERE rank < 1000),
       kept AS (SELECT * FROM scored WHERE asked = 'contents' OR NOT toc)
       SELECT asked, key, fusion_score FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY rank) AS n FROM kept) WHERE n <= 20""",
)
def contents_last(t: Tables) -> DataFrame:
    """Candidates from contents pages go if there are others, and stay, with less, if there are none."""
    toc = (F.col("p_partkey") % 3 == 0) | (F.col("p_partkey") % 5 == 0)
    text = F.when(F.col("p_partkey") % 3 == 0, "目录").when(F.col("p_partkey") % 5 == 0, "见目次").otherwise("text")
    rows = t.part.select(F.lit("sparse").alias("route"), F.col("p_partkey").cast("string").alias("item_id"), F.col("p_partkey").cast("long").alias("doc_id"), F.lit("content").alias("kind"), F.lit("").alias("title"), text.alias("text"), F.col("p_retailprice").alias("score"), F.lit(None).cast("string").alias("target_id"), F.lit(None).cast("string").alias("table_id"), F.lit("body").alias("section_path"), F.lit(3).alias("page_idx"), toc.alias("toc"))
    shown = [search.fuse(part.drop("toc"), task="definition_qa", top=20).select(F.lit(asked).alias("asked"), "key", "fusion_score") for asked, part in (("all", rows), ("contents", rows.where("toc")))]
    return shown[0].union(shown[1])


_TABLE_SQL = f"WITH {{blocks}}, {routes.CHUNKS_SQL}, {routes.TABLES_SQL}, {routes.table_sql(routes.QUESTION)}, {routes.formula_sql(routes.QUESTION)}, candidates AS (SELECT route, {routes.COLUMNS} FROM table_route UNION ALL SELECT route, {routes.COLUMNS} FROM formula), {routes.fusion_sql(routes.QUESTION)}"


@query(
    "search_adapters",
    f"""SELECT 'knowledge_search' AS tool, key AS item, round(rerank_score, 6) AS score FROM ({routes.HYBRID_SQL})
        UNION ALL SELECT 'table_search', key, round(rerank_score, 6) FROM ({_TABLE_SQL})
        UNION ALL SELECT 'entity_search', CAST(s_suppkey AS VARCHAR), 1.0 FROM supplier WHERE contains(lower(s_name), '#000000007')""",
)
def search_adapters(t: Tables) -> DataFrame:
    """The three searches, called alike. Two of them ask the same, so the candidates of a question are found once."""
    asked_before: dict[Question, dict[str, DataFrame]] = {}

    def sources(q: Question) -> dict[str, DataFrame]:
        if q not in asked_before:
            given = routes.sources(t, q)
            few = written(reduce(DataFrame.unionByName, given.values()))  # some hundred rows
            asked_before[q] = {name: few.where(F.col("route") == name) for name in given}
        return asked_before[q]

    entities = t.supplier.select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("long").alias("doc_id"))
    searches = adapters.Searches(sources, entities).tools()
    asked = {"knowledge_search": routes.QUESTION.text, "table_search": routes.QUESTION.text, "entity_search": "#000000007"}
    parts = [searches[tool](text, top=routes.TOP, task="table_qa").select(F.lit(tool).alias("tool"), F.col("key").alias("item"), F.round("score", 6).alias("score")) for tool, text in asked.items()]
    return parts[0].union(parts[1]).union(parts[2])
