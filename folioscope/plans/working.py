"""Records, sessions, memory, evaluation, table lookup and calculation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators import evaluate, lookup, records
from folioscope.plans.registry import Tables, query


@query("dedupe_latest", "SELECT user_id, event_type, max(event_id) AS event_id, max_by(value, struct_pack(a := ts, b := event_id)) AS value FROM events GROUP BY 1, 2")
def dedupe_latest(t: Tables) -> DataFrame:
    return records.latest(t.events.select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query(
    "lww_upsert",
    """WITH a AS (SELECT * FROM events), b AS (SELECT event_id - 2500 AS event_id, ts, event_type || '!' AS event_type, value FROM events)
       SELECT event_id, arg_max(event_type, struct_pack(a := ts, b := n)) AS event_type, arg_max(value, struct_pack(a := ts, b := n)) AS value FROM (SELECT event_id, ts, event_type, value, 0 AS n FROM a UNION ALL SELECT event_id, ts, event_type, value, 1 FROM b) GROUP BY event_id""",
)
def lww_upsert(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "ts", "event_type", "value")
    changes = rows.select((F.col("event_id") - 2500).alias("event_id"), "ts", F.concat("event_type", F.lit("!")).alias("event_type"), "value")
    return records.upsert(rows, changes, ["event_id"], "ts").select("event_id", "event_type", "value")


@query("row_patch", "SELECT c_custkey, CASE WHEN n_nationkey % 2 = 0 AND c_custkey % 3 = 0 THEN n_name ELSE c_mktsegment END AS c_mktsegment, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def row_patch(t: Tables) -> DataFrame:
    changes = t.customer.where("c_custkey % 3 = 0").join(t.nation.where("n_nationkey % 2 = 0"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("c_mktsegment"))
    return records.patch(t.customer.select("c_custkey", "c_mktsegment", "c_name"), changes, "c_custkey", ["c_mktsegment"])


@query("cascade_delete", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 7 = 0) GROUP BY l_orderkey")
def cascade_delete(t: Tables) -> DataFrame:
    gone = t.orders.where("o_orderstatus = 'F' AND o_custkey % 7 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return records.without(t.lineitem, gone, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("stale_tasks", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) THEN 'failed' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def stale_tasks(t: Tables) -> DataFrame:
    alive = t.lineitem.where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return records.stale(t.orders.select("o_orderkey", "o_orderstatus"), status="o_orderstatus", open_states=["O", "P"], alive=alive, key="o_orderkey")


@query(
    "pipeline_status",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'failed' WHEN o_orderstatus = 'P' THEN 'processing' WHEN o_orderkey % 3 = 0 THEN 'partial' ELSE 'completed' END AS status,
              CASE WHEN o_orderkey % 2 = 0 THEN 'fts,vectors,graph' ELSE 'structure,fts,vectors,graph' END AS todo FROM orders""",
)
def pipeline_status(t: Tables) -> DataFrame:
    state = F.create_map(
        F.lit("parse"), F.when(F.col("o_orderkey") % 5 == 0, "failed").otherwise("completed"), F.lit("structure"), F.when(F.col("o_orderstatus") == "P", "processing").otherwise("completed"), F.lit("graph"), F.when(F.col("o_orderkey") % 3 == 0, "failed").otherwise("completed")
    )
    done = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("parse"), F.lit("structure"))).otherwise(F.array(F.lit("parse")))
    return t.orders.select("o_orderkey", records.pipeline_status(state, ["parse"]).alias("status"), F.array_join(records.resume_from(["parse", "structure", "fts", "vectors", "graph"], done), ",").alias("todo"))


@query("incremental_changes", "SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN 'added' WHEN doc_id % 10 = 2 THEN 'removed' ELSE 'changed' END AS change FROM documents WHERE doc_id % 10 IN (1, 2, 3)")
def incremental_changes(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text")
    after = docs.where("doc_id % 10 <> 2").withColumn("text", F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    return records.changed(docs.where("doc_id % 10 <> 1"), after, "doc_id", "text")


@query(
    "budget_compaction",
    """WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN 'tool' ELSE role END AS role, text, length(coalesce(text, '')) AS n FROM conversations),
       s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id) AS total, CASE WHEN role = 'tool' THEN greatest(n - 60, 0) ELSE 0 END AS saving FROM m),
       b AS (SELECT *, coalesce(sum(saving) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
       c AS (SELECT *, saving > 0 AND total / 2 - before / 2 > 400 AS compact FROM b)
       SELECT conv_id, turn, compact, (total - sum(CASE WHEN compact THEN saving ELSE 0 END) OVER (PARTITION BY conv_id)) / 2 > 500 AS halted FROM c""",
)
def budget_compaction(t: Tables) -> DataFrame:
    messages = t.conversations.withColumn("role", F.when(F.col("turn") % 2 == 1, "tool").otherwise(F.col("role")))
    return records.compaction(messages, budget=400, summary=60, stop=500).select("conv_id", "turn", "compact", "halted")


@query("session_memory", "WITH m AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS memory FROM m WHERE turn > last - 3 GROUP BY conv_id")
def session_memory(t: Tables) -> DataFrame:
    return records.transcript(t.conversations, last=3)


@query(
    "session_pool",
    """WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
       s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
       SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts) + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS ended, count(*) AS n FROM s GROUP BY user_id, k""",
)
def session_pool(t: Tables) -> DataFrame:
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return records.sessions(t.events, gap="2 hours", at="ts", who="user_id").select("user_id", shown("started"), shown("ended"), "n")


@query("newest_runs", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 3")
def newest_runs(t: Tables) -> DataFrame:
    return records.newest_runs(t.orders, dataset="o_custkey", order=[F.desc("o_orderdate"), F.desc("o_orderkey")], keep=3).select("o_orderkey")


# ---------------------------------------------------------------- evaluation


@query(
    "eval_hit_mrr",
    """WITH q AS (SELECT doc_id AS question_id, [for_path for for_path in ['A / ' || (doc_id % 3), 'B / ' || (doc_id % 4), '', 'C / ' || (doc_id % 5), 'D']] AS paths, ['/ ' || (doc_id % 2)] AS gold FROM documents),
       hits AS (SELECT question_id, [contains(p, gold[1]) AND trim(p) <> '' for p in paths] AS h, [contains(p, gold[1]) for p in paths if trim(p) <> ''] AS f FROM q)
       SELECT question_id, CASE WHEN list_contains(f[1:1], TRUE) THEN 1.0 ELSE 0.0 END AS hit_1, CASE WHEN list_contains(f[1:3], TRUE) THEN 1.0 ELSE 0.0 END AS hit_3, CASE WHEN list_contains(f[1:5], TRUE) THEN 1.0 ELSE 0.0 END AS hit_5,
              round(coalesce(1.0 / nullif(list_position(h, TRUE), 0), 0), 6) AS mrr FROM hits""",
)
def eval_hit_mrr(t: Tables) -> DataFrame:
    part = lambda name, n: F.concat(F.lit(f"{name} / "), F.col("doc_id") % n)
    rows = t.documents.select(F.col("doc_id").alias("question_id"), F.array(part("A", 3), part("B", 4), F.lit(""), part("C", 5), F.lit("D")).alias("paths"), F.array(F.concat(F.lit("/ "), F.col("doc_id") % 2)).alias("gold"))
    return evaluate.scores(rows).withColumn("mrr", F.round("mrr", 6))


@query(
    "failure_buckets",
    """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'ok' WHEN doc_id % 7 = 1 THEN 'hard_negative_bias' WHEN doc_id % 3 = 0 THEN 'wrong_section_bias' WHEN doc_id % 5 = 0 THEN 'caption_body_confusion' ELSE 'missed_exact_target' END AS bucket FROM documents""",
)
def failure_buckets(t: Tables) -> DataFrame:
    none, one = F.array().cast("array<string>"), lambda *x: F.array(*map(F.lit, x))
    target = F.when(F.col("doc_id") % 7 == 0, one("g")).when(F.col("doc_id") % 7 == 1, one("h")).otherwise(one("x"))
    paths = F.when(F.col("doc_id") % 3 == 0, one("1 / 2")).otherwise(none)
    types = F.when(F.col("doc_id") % 5 == 0, one("content")).otherwise(one("title"))
    return t.documents.select("doc_id", evaluate.failure_bucket(target, paths, types, one("g", ""), one("h"), one("2"), one("figure")).alias("bucket"))


@query(
    "run_compare",
    """WITH a AS (SELECT doc_id, quality FROM labels WHERE doc_id % 5 <> 0), b AS (SELECT doc_id, toxic AS quality FROM labels WHERE doc_id % 5 <> 1)
       SELECT coalesce(a.doc_id, b.doc_id) AS question_id, CAST(a.quality AS DOUBLE) AS before, CAST(b.quality AS DOUBLE) AS after, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' WHEN b.quality > a.quality THEN 'improved' WHEN b.quality < a.quality THEN 'regressed' ELSE 'same' END AS change
       FROM a FULL JOIN b ON a.doc_id = b.doc_id""",
)
def run_compare(t: Tables) -> DataFrame:
    before = t.labels.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("question_id"), F.col("quality").cast("double").alias("score"))
    after = t.labels.where("doc_id % 5 <> 1").select(F.col("doc_id").alias("question_id"), F.col("toxic").cast("double").alias("score"))
    return evaluate.compare_runs(before, after)


@query(
    "question_quality",
    """WITH s AS (SELECT doc_id, [CASE WHEN doc_id % 3 > 0 THEN doc_id % 11 / 10 END, CASE WHEN doc_id % 4 > 0 THEN doc_id % 7 / 6 END] AS scores, CASE WHEN doc_id % 5 > 0 THEN 0.9 END AS fallback FROM documents),
       v AS (SELECT doc_id, coalesce(list_avg([x for x in scores if x IS NOT NULL]), fallback) AS v FROM s) SELECT doc_id, CASE WHEN v IS NULL THEN 'skipped' WHEN v >= 0.8 THEN 'correct' ELSE 'wrong' END AS quality FROM v""",
)
def question_quality(t: Tables) -> DataFrame:
    key = F.col("doc_id")
    scores = F.array(F.when(key % 3 > 0, key % 11 / 10), F.when(key % 4 > 0, key % 7 / 6))
    return t.documents.select("doc_id", evaluate.quality(scores, F.when(key % 5 > 0, 0.9)).alias("quality"))


@query("keyword_checks", "SELECT doc_id, contains(lower(text), 'license') AND contains(lower(text), 'the') AS every, contains(lower(text), 'gnu') OR contains(lower(text), 'apache') AS any FROM documents")
def keyword_checks(t: Tables) -> DataFrame:
    words = lambda *x: F.array(*map(F.lit, x))
    return t.documents.select("doc_id", evaluate.mentions(F.col("text"), words("License", "the"), True).alias("every"), evaluate.mentions(F.col("text"), words("GNU", "Apache"), False).alias("any"))


# ---------------------------------------------------------------- tables and calculation


@query(
    "html_table_rows",
    """SELECT p_size AS table_id, string_agg(p_partkey || '|' || p_name || '|' || p_brand || '|' || p_brand, chr(10) ORDER BY p_partkey) AS body FROM part GROUP BY p_size""",
)
def html_table_rows(t: Tables) -> DataFrame:
    row = F.concat(F.lit("<tr><td> "), "p_partkey", F.lit("</td><td>"), F.col("p_name"), F.lit("</td><td colspan='2'><b>"), "p_brand", F.lit("</b></td></tr>"))
    rows = t.part.groupBy("p_size").agg(F.sort_array(F.collect_list(F.struct("p_partkey", row.alias("row")))).alias("rows"))
    html = F.concat(F.lit("<table>"), F.array_join(F.transform("rows", lambda r: r["row"]), "\n"), F.lit("</table>"))
    return rows.select(F.col("p_size").alias("table_id"), lookup.table_text(lookup.html_rows(html)).alias("body"))


@query("markdown_table_rows", "SELECT s_nationkey AS table_id, 'Suppliers of ' || s_nationkey AS context, 'key|name' || chr(10) || string_agg(s_suppkey || '|' || s_name, chr(10) ORDER BY s_suppkey) AS body FROM supplier GROUP BY s_nationkey")
def markdown_table_rows(t: Tables) -> DataFrame:
    rows = t.supplier.groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", F.concat(F.lit("| "), "s_suppkey", F.lit(" | "), "s_name", F.lit(" |")).alias("row")))).alias("rows"))
    text = F.concat(F.lit("intro\nSuppliers of "), "s_nationkey", F.lit("\n\n| key | name |\n|---|:---:|\n"), F.array_join(F.transform("rows", lambda r: r["row"]), "\n"), F.lit("\n\nafter"))
    found = rows.select(F.col("s_nationkey").alias("table_id"), F.explode(lookup.markdown_tables(text)).alias("t"))
    return found.select("table_id", "t.context", lookup.table_text(F.col("t.rows")).alias("body"))


@query("table_row_chunks", "SELECT p_partkey, 'Parts | name: ' || p_name || ' | 列3: ' || p_brand AS chunk FROM part")
def table_row_chunks(t: Tables) -> DataFrame:
    chunks = lookup.row_chunks(F.lit("Parts"), F.array(F.lit("name"), F.lit("empty")), F.array(F.array("p_name", F.lit(" "), "p_brand"), F.array(F.lit(""))))
    return t.part.select("p_partkey", F.explode(chunks).alias("chunk"))


@query("table_nearest_lookup", "SELECT p_partkey, p_name, round(abs(p_size - 23.4) + abs(p_retailprice - 950.3), 6) AS distance FROM part WHERE p_type = 'ECONOMY' ORDER BY abs(p_size - 23.4) + abs(p_retailprice - 950.3), p_partkey LIMIT 1")
def table_nearest_lookup(t: Tables) -> DataFrame:
    return lookup.nearest_row(t.part, {"p_size": 23.4, "p_retailprice": 950.3}, "p_partkey", where=F.col("p_type") == "ECONOMY").select("p_partkey", "p_name", F.round("distance", 6).alias("distance"))


@query("header_lookup", "SELECT p_partkey, CASE WHEN abs(p_size - 20) <= abs(p_size + 15 - 20) THEN 1 ELSE 2 END AS place, 'value' AS target FROM part")
def header_lookup(t: Tables) -> DataFrame:
    headers = F.array(F.lit("name"), F.concat("p_size", F.lit(" kn")), F.concat(F.col("p_size") + 15, F.lit(" kn")))
    return t.part.select("p_partkey", lookup.nearest_header(headers, 20.0).cast("long").alias("place"), lookup.inferred_target(F.array(F.lit("name"), F.lit("value"), F.lit("备注")), ["name"]).alias("target"))


#: The longest run that two parts of texts share, the first of several: its length, and where it begins in either, negative.
LONGEST_RUN = "list_max(flatten(flatten([[[{'k': k, 'i': -i, 'j': -j} FOR k IN range(1, least(ahi - i, bhi - j) + 1) IF substr(a, i + 1, k) = substr(b, j + 1, k)] FOR j IN range(blo, bhi)] FOR i IN range(alo, ahi)])))"


@query(
    "condition_match",
    f"""WITH RECURSIVE names AS (SELECT DISTINCT p_name, 'redring' AS a, lower(regexp_replace(p_name, '\\s', '', 'g')) AS b FROM part),
        parts AS (  -- the longest run, then what lies before and after it
            SELECT p_name, a, b, 0 AS alo, length(a) AS ahi, 0 AS blo, length(b) AS bhi FROM names
            UNION ALL
            SELECT p_name, a, b, p.alo, p.ahi, p.blo, p.bhi
            FROM (SELECT p_name, a, b, unnest([{{'alo': alo, 'ahi': -m.i, 'blo': blo, 'bhi': -m.j}}, {{'alo': m.k - m.i, 'ahi': ahi, 'blo': m.k - m.j, 'bhi': bhi}}]) AS p FROM (SELECT *, {LONGEST_RUN} AS m FROM parts) WHERE m IS NOT NULL)),
        runs AS (SELECT p_name, a, b, coalesce(sum(m.k), 0) AS common FROM (SELECT *, {LONGEST_RUN} AS m FROM parts) GROUP BY p_name, a, b)
        SELECT p_partkey FROM part JOIN runs USING (p_name) WHERE contains(a, b) OR contains(b, a) OR (least(length(a), length(b)) >= 3 AND 2 * common / (length(a) + length(b)) >= 0.62)""",
)
def condition_match(t: Tables) -> DataFrame:
    """By a common variant, or by the share of common runs."""
    return t.part.where(lookup.condition_matches(F.col("p_name"), "red ring")).select("p_partkey")


@query("conditional_branch", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'closed' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'soon' ELSE 'later' END AS route FROM orders")
def conditional_branch(t: Tables) -> DataFrame:
    urgent = lookup.branch(F.col("o_orderpriority"), [("in", ["1-URGENT", "2-HIGH"], "soon")], "later")
    return t.orders.select("o_orderkey", F.coalesce(lookup.branch(F.col("o_orderstatus"), [("==", "F", "closed")]), urgent).alias("route"))


@query("calculator", "SELECT p_partkey, round(sqrt(p_size * 1.0) + ln(p_retailprice) * 2 - pow(p_size, 2) / 3 + cos(p_size), 6) AS value FROM part")
def calculator(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.round(lookup.compiled("sqrt(p_size) + log(p_retailprice) * 2 - p_size ** 2 / 3 + cos(p_size)", ["p_size", "p_retailprice"]), 6).alias("value"))


@query("expression_forms", "SELECT p_partkey, '(' || p_size || '*1000+2**2)/3' AS form, CAST(p_size AS VARCHAR) AS shown FROM part")
def expression_forms(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("（"), "p_size", F.lit(" × 1,000 ＋ 2²） ÷ 3"))
    return t.part.select("p_partkey", lookup.cleaned_expression(raw).alias("form"), lookup.shown(F.col("p_size").cast("double")).alias("shown"))


@query("section_volume", "SELECT p_partkey, round((p_size * 2 + 3 * 4) * p_retailprice * 1.15, 4) AS volume FROM part")
def section_volume(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.round(lookup.section_volume(F.col("p_size"), F.lit(2), F.col("p_retailprice")), 4).alias("volume"))


@query("template_values", "SELECT c_custkey, 'Dear ' || c_name || ', ${missing} of ' || c_mktsegment || '/' || c_name AS letter FROM customer")
def template_values(t: Tables) -> DataFrame:
    values = F.create_map(F.lit("name"), "c_name", F.lit("of.segment"), "c_mktsegment")
    return t.customer.select("c_custkey", lookup.resolved(F.lit("Dear ${name}, ${missing} of ${of.segment}/${name}"), values).alias("letter"))
