"""Graph checks and trees over the hierarchy of regions, nations, customers and suppliers, and over order lines as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators import components, graph
from folioscope.plans.registry import Tables, query


def _relations(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.concat_ws("-", F.format_string("%09d", "l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey").alias("relation_id"), (F.col("l_partkey") % 500).alias("source_id"), "l_suppkey", F.col("l_suppkey").alias("target_id"), F.col("l_returnflag").alias("relation_type"), F.col("l_orderkey").alias("doc_id")
    ).drop("l_suppkey")


@query(
    "contradiction_pairs",
    """WITH r AS (SELECT lpad(CAST(l_orderkey AS VARCHAR), 9, '0') || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS relation_id, l_partkey % 500 AS source_id, l_suppkey AS target_id, l_returnflag AS relation_type, l_orderkey AS doc_id FROM lineitem)
       SELECT a.relation_id AS first_id, b.relation_id AS second_id, a.source_id, a.target_id, a.relation_type AS first_type, b.relation_type AS second_type FROM r a JOIN r b ON a.source_id = b.source_id AND a.target_id = b.target_id
       WHERE a.relation_id < b.relation_id AND a.doc_id <> b.doc_id AND a.relation_type <> b.relation_type""",
)
def contradiction_pairs(t: Tables) -> DataFrame:
    return graph.contradictions(_relations(t))


@query(
    "contradiction_groups",
    """WITH r AS (SELECT l_partkey % 500 AS source_id, l_suppkey AS target_id, l_returnflag AS relation_type, l_orderkey AS doc_id FROM lineitem),
       groups AS (SELECT source_id, target_id, count(*) AS relations, count(DISTINCT doc_id) AS documents, count(DISTINCT relation_type) AS types FROM r GROUP BY 1, 2),
       pairs AS (SELECT a.source_id, a.target_id, count(*) // 2 AS n_pairs FROM r a JOIN r b ON a.source_id = b.source_id AND a.target_id = b.target_id AND a.doc_id <> b.doc_id AND a.relation_type <> b.relation_type GROUP BY 1, 2)
       SELECT source_id, target_id, n_pairs, relations, documents, types FROM pairs JOIN groups USING (source_id, target_id)""",
)
def contradiction_groups(t: Tables) -> DataFrame:
    """How many pairs contradict each other between the same ends, without the pairs."""
    return graph.contradiction_groups(_relations(t)).withColumn("types", F.size("types").cast("long"))


@query(
    "orphan_entities",
    """SELECT c_custkey AS entity_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
       AND DATE '1998-01-01' + CAST(c_custkey % 60 AS INTEGER) < DATE '1998-02-22' - 7""",
)
def orphan_entities(t: Tables) -> DataFrame:
    """Customers that no pending order names, made more than seven days before the day of the check."""
    edges = t.orders.where("o_orderstatus = 'P'").select(F.concat(F.lit("order-"), "o_orderkey").alias("source_id"), F.col("o_custkey").cast("string").alias("target_id"))
    made = F.date_add(F.lit("1998-01-01").cast("date"), (F.col("c_custkey") % 60).cast("int"))
    entities = t.customer.select(F.col("c_custkey").cast("string").alias("entity_id"), made.alias("created_at"))
    found = graph.orphans(entities, edges, before=F.date_sub(F.lit("1998-02-22").cast("date"), 7), since="created_at")
    return found.select(F.col("entity_id").cast("long").alias("entity_id"))


@query(
    "entity_dedup",
    """WITH e AS (SELECT p_partkey AS entity_id, p_type AS layer, p_name || ' ' || (p_partkey % 97) AS name FROM part)
       SELECT a.layer, a.entity_id AS first_id, b.entity_id AS second_id, round(1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)), 6) AS confidence,
              CASE WHEN length(a.name) >= length(b.name) THEN a.name ELSE b.name END AS canonical, CASE WHEN 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) >= 0.92 THEN 'auto_merge' ELSE 'review' END AS action
       FROM e a JOIN e b ON a.layer = b.layer AND a.entity_id < b.entity_id WHERE 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) >= 0.85""",
)
def entity_dedup(t: Tables) -> DataFrame:
    entities = t.part.select(F.col("p_partkey").alias("entity_id"), "p_type", F.concat_ws(" ", "p_name", F.col("p_partkey") % 97).alias("name"))
    return graph.similar_names(entities, layer="p_type", least=0.85, auto=0.92).withColumn("confidence", F.round("confidence", 6))


@query(
    "graph_stats",
    """WITH {edges}, ends AS (SELECT relation_type, source_id AS id FROM edges UNION ALL SELECT relation_type, target_id FROM edges UNION ALL SELECT 'all', source_id FROM edges UNION ALL SELECT 'all', target_id FROM edges)
       SELECT relation_type, count(*) // 2 AS edges, count(DISTINCT id) AS entities FROM ends GROUP BY relation_type""",
)
def graph_stats(t: Tables) -> DataFrame:
    return graph.edge_stats(t.edges)


@query("neighbourhood", "WITH {edges} SELECT 'out' AS direction, target_id AS other_id, relation_type FROM edges WHERE source_id = 'nation-7' UNION ALL SELECT 'in', source_id, relation_type FROM edges WHERE target_id = 'nation-7'")
def neighbourhood(t: Tables) -> DataFrame:
    return graph.around(t.edges, "nation-7")


@query(
    "graph_snapshot",
    "WITH {edges}, e AS (SELECT 'nation-' || n_nationkey AS id FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'customer-' || c_custkey FROM customer UNION ALL SELECT 'region-' || r_regionkey FROM region) SELECT * FROM edges WHERE source_id IN (SELECT id FROM e) AND target_id IN (SELECT id FROM e) AND relation_type <> 'constrains'",
)
def graph_snapshot(t: Tables) -> DataFrame:
    ids = [t.nation.where("n_nationkey % 2 = 0").selectExpr("concat('nation-', n_nationkey) AS entity_id"), t.customer.selectExpr("concat('customer-', c_custkey) AS entity_id"), t.region.selectExpr("concat('region-', r_regionkey) AS entity_id")]
    return graph.snapshot(t.edges, ids[0].union(ids[1]).union(ids[2]), without=["constrains"])


@query("entities_of_document", "WITH {edges} SELECT DISTINCT entity_id FROM (SELECT source_id AS entity_id FROM edges WHERE doc_id = 'doc-2' UNION ALL SELECT target_id FROM edges WHERE doc_id = 'doc-2')")
def entities_of_document(t: Tables) -> DataFrame:
    return graph.endpoints(t.edges.where("doc_id = 'doc-2'"))


@query("relations_per_document", "WITH {edges} SELECT doc_id, relation_type, count(*) AS n FROM edges GROUP BY 1, 2")
def relations_per_document(t: Tables) -> DataFrame:
    return graph.relations_by_document(t.edges)


@query(
    "entity_upsert",
    """SELECT c_mktsegment AS name, c_nationkey % 5 AS library_id, min(c_custkey) AS entity_id, array_to_string(list_sort(list_distinct(list(left(c_name, 3 + c_custkey % 9)))), ',') AS aliases, max_by(c_name, c_custkey) AS description FROM customer GROUP BY 1, 2""",
)
def entity_upsert(t: Tables) -> DataFrame:
    rows = t.customer.select(
        F.col("c_mktsegment").alias("name"), (F.col("c_nationkey") % 5).alias("library_id"), F.col("c_custkey").alias("entity_id"), F.col("c_custkey").alias("created_at"), F.col("c_name").alias("description"), F.array(F.expr("left(c_name, 3 + c_custkey % 9)")).alias("aliases")
    )
    return graph.upsert_entities(rows).select("name", "library_id", "entity_id", F.array_join("aliases", ",").alias("aliases"), "description")


@query(
    "relation_upsert",
    """WITH r AS (SELECT l_partkey % 50 AS source_id, l_suppkey AS target_id, l_returnflag AS relation_type, l_discount AS confidence, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'line ' || lpad(CAST(l_orderkey AS VARCHAR), 9, '0') || '-' || l_linenumber END AS evidence_text, l_shipdate AS updated_at FROM lineitem)
       SELECT source_id, target_id, relation_type, max(confidence) AS confidence, max(CASE WHEN evidence_text <> '' THEN {'u': updated_at, 'e': evidence_text} END).e AS evidence_text FROM r GROUP BY 1, 2, 3""",
)
def relation_upsert(t: Tables) -> DataFrame:
    told = F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.concat(F.lit("line "), F.format_string("%09d", "l_orderkey"), F.lit("-"), "l_linenumber"))
    rows = t.lineitem.select((F.col("l_partkey") % 50).alias("source_id"), F.col("l_suppkey").alias("target_id"), F.col("l_returnflag").alias("relation_type"), F.col("l_discount").alias("confidence"), told.alias("evidence_text"), F.col("l_shipdate").alias("updated_at"))
    return graph.upsert_relations(rows, ["source_id", "target_id", "relation_type"]).drop("updated_at")


@query(
    "entity_merge",
    """WITH {edges}, m AS (SELECT 'nation-' || n_nationkey AS loser, 'nation-' || (n_nationkey - 1) AS keeper FROM nation WHERE n_nationkey % 4 = 1),
       moved AS (SELECT DISTINCT coalesce(a.keeper, source_id) AS source_id, coalesce(b.keeper, target_id) AS target_id, relation_type, doc_id FROM edges LEFT JOIN m a ON a.loser = source_id LEFT JOIN m b ON b.loser = target_id)
       SELECT * FROM moved WHERE source_id <> target_id""",
)
def entity_merge(t: Tables) -> DataFrame:
    merged = t.nation.where("n_nationkey % 4 = 1").selectExpr("concat('nation-', n_nationkey) AS loser", "concat('nation-', n_nationkey - 1) AS keeper")
    return graph.redirect(t.edges, merged)


@query(
    "merge_chains",
    """WITH RECURSIVE m AS (SELECT n_nationkey AS loser, n_nationkey - 1 AS keeper FROM nation WHERE n_nationkey % 4 > 0),
       walk AS (SELECT loser, keeper, 1 AS n FROM m UNION ALL SELECT w.loser, m.keeper, n + 1 FROM walk w JOIN m ON m.loser = w.keeper WHERE n < 6)
       SELECT loser, max_by(keeper, n) AS keeper FROM walk GROUP BY loser""",
)
def merge_chains(t: Tables) -> DataFrame:
    return graph.final_keepers(t.nation.where("n_nationkey % 4 > 0").selectExpr("n_nationkey AS loser", "n_nationkey - 1 AS keeper"))


@query(
    "cooccurrence",
    """WITH terms AS (SELECT unnest(['the', 'de', 'und', 'License', 'la']) AS term), places AS (SELECT doc_id, term, instr(text, term) AS at FROM documents, terms WHERE instr(text, term) > 0)
       SELECT a.term AS first, b.term AS second, count(*) AS n_docs FROM places a JOIN places b USING (doc_id) WHERE a.term < b.term AND abs(a.at - b.at) <= 200 GROUP BY 1, 2""",
)
def cooccurrence(t: Tables) -> DataFrame:
    return graph.cooccurrences(t.documents, "doc_id", "text", ["the", "de", "und", "License", "la"])


NODES_SQL = """nodes AS (SELECT 'r' || r_regionkey AS node_id, NULL AS parent_id, r_name AS title, r_regionkey AS sort_order FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, n_nationkey % 3 FROM nation
       UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name, s_suppkey % 4 FROM supplier)"""


def tree_nodes(t: Tables) -> DataFrame:
    parts = [
        t.region.selectExpr("concat('r', r_regionkey) AS node_id", "CAST(NULL AS STRING) AS parent_id", "r_name AS title", "CAST(r_regionkey AS BIGINT) AS sort_order"),
        t.nation.selectExpr("concat('n', n_nationkey) AS node_id", "concat('r', n_regionkey) AS parent_id", "n_name AS title", "CAST(n_nationkey % 3 AS BIGINT) AS sort_order"),
        t.supplier.selectExpr("concat('s', s_suppkey) AS node_id", "concat('n', s_nationkey) AS parent_id", "s_name AS title", "CAST(s_suppkey % 4 AS BIGINT) AS sort_order"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("tree_subtree", f"WITH RECURSIVE {NODES_SQL}, walk AS (SELECT node_id, 0 AS depth FROM nodes WHERE node_id = 'r2' UNION ALL SELECT n.node_id, depth + 1 FROM nodes n JOIN walk w ON n.parent_id = w.node_id) SELECT node_id, depth FROM walk")
def tree_subtree(t: Tables) -> DataFrame:
    return graph.subtree(tree_nodes(t), "r2")


@query("tree_paths", f"WITH RECURSIVE {NODES_SQL}, walk AS (SELECT node_id, title AS path FROM nodes WHERE parent_id IS NULL UNION ALL SELECT n.node_id, path || ' / ' || title FROM nodes n JOIN walk w ON n.parent_id = w.node_id) SELECT node_id, path FROM walk")
def tree_paths(t: Tables) -> DataFrame:
    return graph.tree_paths(tree_nodes(t))


@query("sibling_resequence", f"WITH {NODES_SQL} SELECT node_id, row_number() OVER (PARTITION BY parent_id ORDER BY sort_order, node_id) - 1 AS sort_order FROM nodes")
def sibling_resequence(t: Tables) -> DataFrame:
    return graph.renumbered(tree_nodes(t)).select("node_id", "sort_order")


@query("next_sibling_order", f"WITH {NODES_SQL} SELECT parent_id, max(sort_order) + 1 AS next_order FROM nodes GROUP BY parent_id")
def next_sibling_order(t: Tables) -> DataFrame:
    return graph.next_order(tree_nodes(t))


@query(
    "step_validation",
    """WITH RECURSIVE s AS (SELECT p_partkey AS step_id, CASE WHEN p_partkey % 10 = 9 THEN p_partkey - 4 WHEN p_partkey % 25 = 0 THEN p_partkey + 1000000 ELSE p_partkey + 1 END AS next_id FROM part),
       walk AS (SELECT step_id, next_id AS spot FROM s UNION SELECT w.step_id, s.next_id FROM walk w JOIN s ON s.step_id = w.spot)
       SELECT step_id, 'dangling' AS problem FROM s WHERE next_id NOT IN (SELECT step_id FROM s) UNION ALL SELECT step_id, 'cycle' FROM walk WHERE step_id = spot""",
)
def step_validation(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    after = F.when(key % 10 == 9, key - 4).when(key % 25 == 0, key + 1_000_000).otherwise(key + 1)
    return graph.cycles_and_gaps(t.part.select(key.alias("step_id"), after.alias("next_id")))


@query(
    "entity_merge",
    """WITH RECURSIVE e AS (SELECT p_partkey AS id, p_type AS layer, p_name || ' ' || (p_partkey % 97) AS name FROM part),
       firsts AS (SELECT layer, name, min(id) AS first FROM e GROUP BY layer, name),
       alike AS (SELECT a.first AS a, b.first AS b FROM firsts a JOIN firsts b ON a.layer = b.layer AND a.first < b.first WHERE 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) >= 0.92),
       links AS (SELECT a, b FROM alike UNION ALL SELECT b, a FROM alike),
       reach AS (SELECT first AS id, first AS other FROM firsts UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.other),
       tops AS (SELECT id, min(other) AS top FROM reach GROUP BY id),
       merged AS (SELECT e.id, e.name, top FROM e JOIN firsts USING (layer, name) JOIN tops ON tops.id = firsts.first)
       SELECT top AS entity_id, count(*) - 1 AS merged, md5(string_agg(DISTINCT name, ',' ORDER BY name)) AS names FROM merged GROUP BY top""",
)
def entity_merge(t: Tables) -> DataFrame:
    """Parts merged along all links of equal and similar names: how many each keeper took in, and the names it goes by."""
    entities = t.part.select(F.col("p_partkey").alias("entity_id"), "p_type", F.concat_ws(" ", "p_name", F.col("p_partkey") % 97).alias("name"), F.array().cast("array<string>").alias("aliases"))
    tied = components.components(components.merge_pairs(entities, layer="p_type", least=0.92), "first_id", "second_id")
    losers = tied.where("id <> component").select(F.col("id").alias("loser"), F.col("component").alias("keeper"))
    kept, _ = graph.merged_entities(entities, t.edges, losers)
    counts = losers.groupBy(F.col("keeper").alias("entity_id")).agg(F.count("*").alias("n"))
    names = F.md5(F.array_join(F.array_sort(F.array_union("aliases", F.array("name"))), ","))
    return kept.join(counts, "entity_id", "left").select("entity_id", F.coalesce("n", F.lit(0)).alias("merged"), names.alias("names"))
