"""Terms in texts, tables and their continuations, evidence, procedures, evaluation and trees: each over whole tables, by known values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import terms
from folioscope.functions.text import clause_refs, first_number
from folioscope.operators import edits, evaluate, evidence, graph, steps, tables
from folioscope.plans.graphs import NODES_SQL, tree_nodes
from folioscope.plans.registry import Tables, query

# ---------------------------------------------------------------- texts


@query(
    "clause_extraction",
    """SELECT p_partkey, (p_size % 9 + 1) || '.' || (p_partkey % 5 + 1) || '.2' AS loose, CASE WHEN p_partkey % 2 = 0 THEN (p_size % 9 + 1) || '.' || (p_partkey % 5 + 1) || '.2' ELSE '' END AS strict, '6.2' AS spoken FROM part""",
)
def clause_extraction(t: Tables) -> DataFrame:
    """Clause numbers in loose, strict and spoken form; blanks and hyphens are no strict form without a word."""
    number = F.concat_ws("-", F.col("p_size") % 9 + 1, F.col("p_partkey") % 5 + 1, F.lit(2))
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("第 "), number, F.lit(" 条"))).otherwise(F.concat(F.lit("see "), number, F.lit(" m")))
    return t.part.select("p_partkey", F.array_join(clause_refs(text), ",").alias("loose"), F.array_join(terms.strict_clause_refs(text), ",").alias("strict"), F.array_join(clause_refs(F.lit("按六点二")), ",").alias("spoken"))


@query("formula_identifiers", "SELECT p_partkey, 'varepsilon_r,' || CASE WHEN p_size % 2 = 0 THEN 'sigma' ELSE 'tau_' || p_size % 7 END AS symbols, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS hits FROM part")
def formula_identifiers(t: Tables) -> DataFrame:
    text = F.concat(F.lit(r"ε_\mathrm{r} = a \cdot "), F.when(F.col("p_size") % 2 == 0, "σ").otherwise(F.concat(F.lit("τ_"), F.col("p_size") % 7)), F.lit(" + kN"))
    return t.part.select("p_partkey", F.array_join(terms.formula_identifiers(text), ",").alias("symbols"), terms.identifier_hits(["varepsilon_r", "sigma"], text).cast("long").alias("hits"))


@query(
    "structure_numbers",
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN (p_size % 9 + 1) || '.' || (p_partkey % 5 + 1) WHEN 1 THEN '附录B' END AS number, CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 END AS level, CASE WHEN p_partkey % 7 = 0 THEN 0.0 WHEN p_partkey % 2 = 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 0.8 ELSE 0.3 END ELSE CASE WHEN p_partkey % 3 = 0 THEN 0.95 ELSE 0.6 END END AS trust FROM part""",
)
def structure_numbers(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    text = F.when(key % 3 == 0, F.concat(F.col("p_size") % 9 + 1, F.lit("."), key % 5 + 1, F.lit(" "), "p_name")).when(key % 3 == 1, F.concat(F.lit("附录B "), "p_name")).otherwise(F.col("p_name"))
    trust = terms.level_confidence(text, F.when(key % 7 != 0, F.lit(1)), key % 2 == 0)
    return t.part.select("p_partkey", terms.structure_number(text).alias("number"), terms.structure_level(text).cast("long").alias("level"), trust.alias("trust"))


@query(
    "keyword_tags",
    """SELECT p_partkey, array_to_string([x FOR x IN [CASE WHEN p_partkey % 2 = 0 THEN '强制性条文' END, CASE WHEN p_partkey % 3 = 0 THEN '抗震' END, CASE WHEN p_partkey % 5 = 0 THEN '表格' END] IF x IS NOT NULL], ',') AS tags, CASE WHEN p_partkey % 2 = 0 THEN '强制性条文' ELSE '' END AS conditions,
              CASE WHEN p_partkey % 4 = 0 THEN 'action' WHEN p_partkey % 4 = 1 THEN 'condition' ELSE 'concept' END AS layer, CASE WHEN contains(p_name, 'red') THEN 'colour' ELSE '' END AS found FROM part""",
)
def keyword_tags(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    text = F.concat_ws(" ", "p_name", F.when(key % 2 == 0, "不得"), F.when(key % 3 == 0, "抗震"))
    section = F.when(key % 5 == 0, "表 1").otherwise("")
    name = F.concat("p_name", F.when(key % 4 == 0, "计算工况").when(key % 4 == 1, "水位").otherwise(""))
    return t.part.select("p_partkey", F.array_join(terms.tags(text, section), ",").alias("tags"), F.array_join(terms.conditions(text, section), ",").alias("conditions"), terms.entity_layer(name).alias("layer"), F.array_join(terms.found_terms(F.col("p_name"), {"red": "colour"}), ",").alias("found"))


@query(
    "asked_clauses",
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN (p_size % 9 + 1) || '.2' WHEN 1 THEN '1.' || (p_size % 9 + 1) END AS clause, CASE WHEN p_partkey % 2 = 0 THEN 'JTS 165-' || (p_size + 1990) || ',GB/T 50' ELSE '' END AS codes FROM part""",
)
def asked_clauses(t: Tables) -> DataFrame:
    """Clauses that a question names as such; what a unit follows is a measure."""
    key, n = F.col("p_partkey"), F.col("p_size") % 9 + 1
    text = F.when(key % 3 == 0, F.concat(F.lit("按第"), n, F.lit(".2条取"))).when(key % 3 == 1, F.concat(F.lit("A.1."), n, F.lit(" 款"))).otherwise(F.concat(F.lit("第"), n, F.lit(".5m")))
    codes = F.when(key % 2 == 0, F.concat(F.lit("见 JTS 165-"), F.col("p_size") + 1990, F.lit(" 与 GB/T 50"))).otherwise("见规范")
    return t.part.select("p_partkey", terms.asked_clause(text).alias("clause"), F.array_join(terms.standard_codes(codes), ",").alias("codes"))


@query(
    "formula_parameters",
    """SELECT p_partkey, '5.2.' || p_size AS number, 'F = q L' AS body, CASE p_partkey % 3 WHEN 0 THEN 'q' WHEN 1 THEN 'L_1' END AS symbol, CASE p_partkey % 3 WHEN 0 THEN 'kN/m' WHEN 1 THEN 'm' END AS unit, CASE WHEN p_partkey % 3 = 0 THEN '按表 ' || p_size || ' 采用' END AS hint FROM part""",
)
def formula_parameters(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    formula = F.concat(F.lit(r"F = q  L \tag{5.2."), F.col("p_size"), F.lit("}"))
    line = F.when(key % 3 == 0, F.concat(F.lit("式中：q——荷载（kN/m），按表 "), F.col("p_size"), F.lit(" 采用；"))).when(key % 3 == 1, F.lit("L_1 计算长度（见图）(m)")).otherwise(F.lit("= 12"))
    line = F.when(key % 3 == 1, F.lit("L_1 长度(m)")).otherwise(line)
    told = terms.parameter(line)
    return t.part.select("p_partkey", terms.formula_number(formula, F.array(line)).alias("number"), terms.without_tag(formula).alias("body"), told["symbol"].alias("symbol"), told["unit"].alias("unit"), told["reference_hint"].alias("hint"))


@query(
    "reference_labels",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '表' || p_size || '.2' WHEN 1 THEN '第' || p_size || '条' WHEN 2 THEN 'Brand' ELSE '公式条文' END AS label FROM part""",
)
def reference_labels(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    section = F.when(key % 4 == 0, F.concat(F.lit("x / 表 "), F.col("p_size"), F.lit(".2 值"))).when(key % 4 == 2, "Part > Brand").otherwise("")
    text = F.when(key % 4 == 1, F.concat(F.lit("见第 "), F.col("p_size"), F.lit("条"))).otherwise(F.lit("plain"))
    return t.part.select("p_partkey", terms.reference_label(section, text, F.lit("formula")).alias("label"))


@query(
    "answer_forms",
    """SELECT p_partkey, 'q=' || p_size || '.5%(约)' AS form, p_partkey % 5 = 0 AS refuses, p_partkey % 2 = 0 AND p_partkey % 3 <> 0 AS unsupported FROM part""",
)
def answer_forms(t: Tables) -> DataFrame:
    """Normalised answers, answers that decline, and standards that the evidence lacks."""
    key = F.col("p_partkey")
    answer = F.concat(F.lit(" Q = "), F.col("p_size"), F.lit(".5％ （约） ！"))
    told = F.when(key % 5 == 0, "抱歉，没有检索到足够证据。").otherwise("q")
    named = F.when(key % 2 == 0, "见 XY 165-2009 的规定").otherwise("见规定")
    corpus = F.when(key % 3 == 0, "XY 165 规定").otherwise("规定")
    return t.part.select("p_partkey", terms.eval_form(answer).alias("form"), terms.refuses(told).alias("refuses"), terms.unsupported_reference(named, corpus).alias("unsupported"))


@query(
    "document_titles",
    """SELECT p_partkey, 'JTS 165-' || (p_size + 1990) || ' ' || p_name AS form, p_size % 2 = 0 OR p_size = 11 AS fits, CASE WHEN p_size >= 60 THEN p_size // 60 || '分' || p_size % 60 || '秒' WHEN p_size * 100 >= 3600 THEN (p_size * 100 // 3600) || '小时' || (p_size * 100 % 3600 // 60) || '分' || (p_size * 100 % 60) || '秒' WHEN p_size * 100 >= 60 THEN (p_size * 100 // 60) || '分' || (p_size * 100 % 60) || '秒' END AS took FROM part""",
)
def document_titles(t: Tables) -> DataFrame:
    size = F.col("p_size")
    raw = F.concat(F.lit("markdown/JTS_165—"), size + 1990, F.lit("_ "), "p_name", F.lit(".md"))
    title = F.when(size % 2 == 0, F.concat(F.lit("jts 165 standard "), size)).otherwise(F.concat(F.lit("code 2001"), F.when(size == 11, "").otherwise("x")))
    asked = F.when(size % 2 == 0, F.lit("JTS 165 other")).otherwise(F.lit("code 2001"))
    fits = F.when((size % 2 == 1) & (size != 11), terms.titles_fit(F.lit("quite another code"), title)).otherwise(terms.titles_fit(asked, title))
    return t.part.select("p_partkey", terms.document_form(raw).alias("form"), fits.alias("fits"), terms.elapsed(size * 100).alias("took"))


@query(
    "given_conditions",
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'size=' || p_size || ';type=' || p_type WHEN 1 THEN 'size=' || p_size ELSE '' END AS conditions, CAST(p_size AS DOUBLE) + 0.5 AS number, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) || ' m' END AS value FROM part""",
)
def given_conditions(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    text = F.when(key % 3 == 0, F.to_json(F.struct(F.col("p_size").cast("string").alias("size"), F.col("p_type").alias("type")))).when(key % 3 == 1, F.concat(F.lit(" size : "), "p_size")).otherwise("no condition at all")
    pairs = F.array_sort(F.transform(F.map_entries(terms.given_conditions(text)), lambda e: F.concat_ws("=", e["key"], e["value"])))
    told = F.when(key % 2 == 0, F.concat(F.lit("水深为 "), F.col("p_size"), F.lit(" m，其余"))).otherwise("无")
    return t.part.select("p_partkey", F.array_join(pairs, ";").alias("conditions"), first_number(F.concat(F.lit("约"), "p_size", F.lit(".5kN/3"))).alias("number"), terms.value_after(told, ["水深"]).alias("value"))


# ---------------------------------------------------------------- tables


@query(
    "lookup_headers",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'name|low|high' WHEN p_partkey % 3 = 1 THEN 'name|size' ELSE 'a|b' END AS headers, p_name || '|' || p_size AS body, CASE WHEN p_partkey % 2 = 0 THEN 'Table ' || p_size ELSE 'line before' END AS context FROM part""",
)
def lookup_headers(t: Tables) -> DataFrame:
    """Headers of two merged rows, of one row, and of a table's head."""
    key = F.col("p_partkey")
    cells = F.concat(F.lit("<tr><td>"), "p_name", F.lit("</td><td>"), "p_size", F.lit("</td></tr>"))
    two = F.lit("<tr><th rowspan='2'>name</th><th colspan='2'>size</th></tr><tr><th>low</th><th>high</th></tr>")
    head = F.when(key % 3 == 0, two).when(key % 3 == 1, F.lit("<tr><td>name</td><td>size</td></tr>")).otherwise(F.lit("<thead><tr><th>a</th><th>b</th></tr></thead><tbody>"))
    before = F.when(key % 2 == 0, F.concat(F.lit("<p>Table "), "p_size", F.lit("</p>"))).otherwise("first\nline before\n")
    found = t.part.select("p_partkey", tables.lookup_tables(F.concat(before, F.lit("<table>"), head, cells, F.lit("</table>"))).alias("f"))
    return found.select("p_partkey", F.array_join("f.headers", "|").alias("headers"), F.array_join(F.flatten("f.rows"), "|").alias("body"), "f.context")


@query(
    "table_joining",
    """SELECT p_partkey, '<table><tr><td>name</td></tr><tr><td>' || p_name || '</td></tr>' || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '<tr><th>other</th></tr>' END || '<tr><td>' || p_size || '</td></tr></table>' AS html FROM part""",
)
def table_joining(t: Tables) -> DataFrame:
    head = F.concat(F.lit("<table><tr><td>name</td></tr><tr><td>"), "p_name", F.lit("</td></tr></table>"))
    again = F.when(F.col("p_partkey") % 2 == 0, "<tr><th> name</th></tr>").otherwise("<tr><th>other</th></tr>")
    return t.part.select("p_partkey", tables.joined_html(head, F.concat(F.lit("<TABLE>"), again, F.lit("<tr><td>"), "p_size", F.lit("</td></tr></TABLE>"))).alias("html"))


@query(
    "table_representation",
    """WITH x AS (SELECT p_partkey, p_name, p_size, p_partkey % 2 = 0 AS words FROM part)
       SELECT p_partkey || ':summary' AS chunk_id, 'table_summary' AS chunk_type, '表格《' || p_name || '》包含 2 行、2 列。' AS text FROM x
       UNION ALL SELECT p_partkey || ':row:0', CASE WHEN p_partkey % 4 = 0 THEN 'table_mapping_row' ELSE 'table_text_row' END, p_name || ' | key: a | value: ' || p_size FROM x WHERE words UNION ALL SELECT p_partkey || ':row:1', CASE WHEN p_partkey % 4 = 0 THEN 'table_mapping_row' ELSE 'table_text_row' END, p_name || ' | key: b' FROM x WHERE words""",
)
def table_representation(t: Tables) -> DataFrame:
    kind = F.when(F.col("p_partkey") % 4 == 0, "mapping_enum").when(F.col("p_partkey") % 2 == 0, "text_dense").otherwise("numeric_dense")
    rows = F.array(F.array(F.lit("a"), F.col("p_size").cast("string")), F.array(F.lit(" b"), F.lit(" ")))
    shown = tables.represented(F.col("p_name"), F.array(F.lit("key"), F.lit(" value ")), rows, kind)
    return tables.table_chunks(t.part.select(F.col("p_partkey").cast("string").alias("table_id"), kind.alias("table_type"), shown.alias("shown"))).drop("table_id")


@query(
    "table_selection",
    """SELECT p_partkey, CASE WHEN p_size BETWEEN 3 AND 9 THEN 280 ELSE 0 END AS ranged, CASE WHEN p_size = 7 THEN 300 ELSE 0 END AS exact, CASE WHEN p_size BETWEEN 3 AND 9 THEN p_size END AS number, CASE WHEN p_size <= 10 THEN 60 WHEN p_size - 10 <= 1 THEN 50 ELSE 35 END AS fit FROM part""",
)
def table_selection(t: Tables) -> DataFrame:
    caption = F.concat(F.lit("表 A.0.2-"), "p_size", F.lit(" 富裕深度"))
    cells = F.array(F.lit("x"), F.lit("1~10"))
    fit = tables.numeric_fit(cells, F.col("p_size").cast("double"))
    return t.part.select("p_partkey", tables.reference_score("表A.0.2-3~表A.0.2-9", caption).cast("long").alias("ranged"), tables.reference_score("表A.0.2-7", caption).cast("long").alias("exact"), tables.in_range(F.replace(caption, F.lit(" A"), F.lit("A")), "表A.0.2-3~表A.0.2-9").cast("long").alias("number"), fit.cast("long").alias("fit"))


@query(
    "column_resolution",
    """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 2 END AS place, 2 AS skipped, CAST(NULL AS BIGINT) AS none FROM part""",
)
def column_resolution(t: Tables) -> DataFrame:
    """A column by a variant of its name; one that a dimension names is left out; and none."""
    headers = F.array(F.lit("序号"), F.when(F.col("p_size") % 2 == 0, "船舶 吨级").otherwise("水深（m）"), F.lit("设计吨级（DWT）9"))
    place, skipped = tables.column_index(headers, "吨级条件", ["GT"]), tables.column_index(F.array(F.lit("航速（kn）"), F.lit("x"), F.lit("航速 5 kn")), "航速")
    return t.part.select("p_partkey", place.cast("long").alias("place"), skipped.cast("long").alias("skipped"), tables.column_index(headers, "材料").cast("long").alias("none"))


@query(
    "row_lookup",
    """SELECT p_partkey AS row_index, round(abs(p_retailprice - 950.3), 6) AS distance, p_brand AS value FROM part WHERE p_type = 'ECONOMY' ORDER BY abs(p_retailprice - 950.3), p_partkey LIMIT 1""",
)
def row_lookup(t: Tables) -> DataFrame:
    """The nearest row among those that fit in words."""
    rows = t.part.select(F.col("p_partkey").alias("row_index"), F.array("p_type", F.col("p_retailprice").cast("string"), "p_brand").alias("cells"))
    found = tables.looked_up(rows, ["类型", "价格", "品牌"], {"类型": "economy", "价格": "950.3"}, "品牌")
    return found.select("row_index", F.round("distance", 6).alias("distance"), "value")


@query(
    "table_continuation",
    """WITH {blocks}, tb AS (SELECT doc_id, block_id, page_idx, reading_order AS seq, pos FROM blocks WHERE pos % 20 IN (1, 19) ), ti AS (SELECT doc_id, page_idx, pos % 20 AS seq FROM blocks WHERE pos % 60 = 0),
       edge AS (SELECT doc_id, page_idx, max_by(block_id, seq) AS last_id, max(seq) AS last_seq, max_by(pos, seq) AS last_pos, min_by(block_id, seq) AS first_id, min(seq) AS first_seq, min_by(pos, seq) AS first_pos FROM tb GROUP BY 1, 2)
       SELECT a.doc_id, a.last_id AS source_id, b.first_id AS target_id FROM edge a JOIN edge b ON b.doc_id = a.doc_id AND b.page_idx = a.page_idx + 1
       WHERE (a.last_pos % 3 = b.first_pos % 3 OR b.first_pos % 4 = 1) AND NOT EXISTS (SELECT 1 FROM ti WHERE ti.doc_id = a.doc_id AND ((ti.page_idx = a.page_idx AND ti.seq > a.last_seq) OR (ti.page_idx = a.page_idx + 1 AND ti.seq < b.first_seq)))""",
)
def table_continuation(t: Tables) -> DataFrame:
    pos = F.col("pos")
    own = t.blocks.where((pos % 20).isin(1, 19)).select("doc_id", F.col("block_id").alias("table_id"), "page_idx", F.col("reading_order").alias("seq"), F.lit(None).cast("string").alias("number"), (pos % 3 + 1).alias("columns"), F.lit(100.0).alias("width"), F.array(pos.cast("string")).alias("header"), (pos % 4 == 1).alias("marked"))
    titles = t.blocks.where(pos % 60 == 0).select("doc_id", "page_idx", F.col("reading_order").alias("seq"))
    return tables.continued(own, titles)


@query(
    "table_attachments",
    """WITH {blocks} SELECT 'T' || b.doc_id AS table_id, b.block_id FROM blocks b WHERE b.page_idx = 1 AND b.block_type IN ('title', 'paragraph', 'list_item') AND b.reading_order <= 4""",
)
def table_attachments(t: Tables) -> DataFrame:
    rows = t.blocks.select("doc_id", "page_idx", "block_id", "block_type", F.lit(None).cast("string").alias("layout_category"), F.lit("续表 D.6.2-4").alias("text"), (F.col("reading_order") / 20 + 0.05).alias("y0"))
    merged = t.documents.select(F.concat(F.lit("T"), "doc_id").alias("table_id"), "doc_id", F.lit(1).cast("long").alias("page_idx"), F.lit("D.6.2-4").alias("number"))
    return tables.attachments(merged, rows)


# ---------------------------------------------------------------- evidence


@query(
    "markdown_parsing",
    """WITH {blocks}, t AS (SELECT *, CAST(sum(CASE WHEN block_type = 'title' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) - 1 AS section FROM blocks WHERE trim(text) <> '' OR block_type = 'title')
       SELECT doc_id, section, 'Page ' || section AS heading, count(*) - 1 AS lines FROM t GROUP BY doc_id, section""",
)
def markdown_parsing(t: Tables) -> DataFrame:
    """Documents as Markdown with a heading per page, parsed into sections."""
    shown = F.when(F.col("block_type") == "title", F.concat(F.lit("## Page "), "page_idx")).otherwise(F.concat(F.lit("line "), F.trim(F.regexp_replace("text", "^[#\\s]+", "x"))))
    lines = t.blocks.where("trim(text) <> '' OR block_type = 'title'").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", shown.alias("line")))).alias("lines"))
    docs = lines.select("doc_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("md"))
    found = evidence.markdown_sections(docs, "doc_id", "md")
    return found.select("doc_id", "section", "heading", F.when(F.col("body") == "", 0).otherwise(F.size(F.split("body", "\n"))).cast("long").alias("lines"))


@query(
    "section_items",
    """SELECT doc_id, 0 AS item, 1 AS section FROM documents UNION ALL SELECT doc_id, 1, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END FROM documents UNION ALL SELECT doc_id, 2, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END FROM documents""",
)
def section_items(t: Tables) -> DataFrame:
    """Items by their path, by the heading before them where there is one, else by where their content is."""
    names = F.array(*(F.struct(F.lit(n).cast("long").alias("section"), F.lit(h).alias("heading"), F.lit(b).alias("body")) for n, h, b in ((0, "", "intro text"), (1, "One", "first body"), (2, "Two", "second body"))))
    sections = t.documents.select("doc_id", F.explode(names).alias("s")).select("doc_id", "s.*")
    even = F.col("doc_id") % 2 == 0
    item = lambda n, kind, content, path: F.struct(F.lit(n).alias("item"), kind.alias("type"), F.lit(content).alias("content"), F.lit(path).alias("section_path"))
    rows = F.array(item(0, F.lit("text"), "x", "One"), item(1, F.when(even, "heading").otherwise("text"), "Two", None), item(2, F.lit("text"), "intro", "no such path"))
    items = t.documents.select("doc_id", F.explode(rows).alias("i")).select("doc_id", "i.*")
    items = items.withColumn("content", F.when((F.col("item") == 1) & (F.col("doc_id") % 2 == 1), "first").otherwise(F.col("content")))
    return evidence.in_sections(items, sections, "doc_id").select("doc_id", "item", "section")


@query(
    "packet_fields",
    """WITH {blocks} SELECT doc_id, page_idx, string_agg(block_id, ',' ORDER BY pos) AS ids, count(DISTINCT CASE WHEN block_type = 'formula' AND text <> '' THEN text END) AS formulas, string_agg(DISTINCT block_type, ',' ORDER BY block_type) AS entities FROM blocks GROUP BY 1, 2""",
)
def packet_fields(t: Tables) -> DataFrame:
    items = t.blocks.select("doc_id", "page_idx", F.col("pos").alias("item"), F.col("block_id").alias("id"), F.col("block_type").alias("type"), F.col("text").alias("content"), F.lit(None).cast("string").alias("formula"), F.array("block_type").alias("entities"), F.lit(None).cast("array<string>").alias("conditions"))
    found = evidence.packet_fields(items, ["doc_id", "page_idx"])
    return found.select("doc_id", "page_idx", F.array_join("block_ids", ",").alias("ids"), F.size("formulas").cast("long").alias("formulas"), F.array_join(F.array_sort("entities"), ",").alias("entities"))


@query(
    "formula_explanations",
    r"""WITH {blocks}, b AS (SELECT *, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '^[；;]+|[；;]+$', '', 'g') AS line FROM blocks),
        near AS (SELECT f.block_id, b.line, b.pos, row_number() OVER (PARTITION BY f.block_id ORDER BY b.pos) AS n FROM b f JOIN b ON b.doc_id = f.doc_id AND b.pos > f.pos AND b.page_idx <= f.page_idx + 1 WHERE f.block_type = 'formula' AND b.block_type IN ('paragraph', 'list_item') AND b.line <> '')
        SELECT f.block_id, coalesce(string_agg(near.line, chr(10) ORDER BY near.pos), '') AS lines FROM b f LEFT JOIN near ON near.block_id = f.block_id AND n <= 8 WHERE f.block_type = 'formula' GROUP BY f.block_id""",
)
def formula_explanations(t: Tables) -> DataFrame:
    found = evidence.explanations(t.blocks.withColumn("section_path", F.lit("")))
    return found.select("block_id", F.array_join("lines", "\n").alias("lines"))


@query(
    "formula_facts",
    """SELECT p_partkey, '公式(3.' || p_size || ') F = q L (3.' || p_size || ')；包含 2 个参数：q, L' AS summary, 2 AS n, 'q:kN/m;L:' AS params FROM part""",
)
def formula_facts(t: Tables) -> DataFrame:
    lines = F.array(F.lit("式中：q——荷载（kN/m）；L——长度"), F.lit("与上式相同"))
    # a file of small rows is one task or few, and here the work is in each row: the rows are dealt first
    parts = t.part.select("p_partkey", "p_size").repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    found = evidence.formula_facts(parts.select("p_partkey", F.concat(F.lit("F = q  L (3."), "p_size", F.lit(")")).alias("text"), lines.alias("lines")))
    params = F.array_join(F.transform("formula_params", lambda p: F.concat(p["symbol"], F.lit(":"), F.coalesce(p["unit"], F.lit("")))), ";")
    return found.select("p_partkey", F.col("formula_summary").alias("summary"), F.col("formula_param_count").cast("long").alias("n"), params.alias("params"))


SEEDS = [("the", "condition", ["The"]), ("de", "action", []), ("License", "concept", ["Apache"])]
_SEEN = "seen AS (SELECT doc_id, s.name, s.layer FROM documents, (VALUES ('the', 'The', 'condition'), ('de', 'de', 'action'), ('License', 'Apache', 'concept')) s(name, alias, layer) WHERE contains(text, s.name) OR contains(text, s.alias))"


@query("seed_relations", f"WITH {_SEEN} SELECT a.name AS source, b.name AS target, CASE a.layer WHEN 'condition' THEN 'conditions_on' WHEN 'action' THEN 'computes_from' ELSE 'constrains' END AS relation_type, count(*) AS n FROM seen a JOIN seen b USING (doc_id) WHERE a.name <> b.name AND b.name <> 'de' GROUP BY 1, 2, 3")
def seed_relations(t: Tables) -> DataFrame:
    """What every two seeds of a document are to each other; one of them is ignored as a target."""
    seeds = t.spark.createDataFrame(SEEDS, "name string, layer string, aliases array<string>")
    packets = t.documents.where("text IS NOT NULL").select(F.col("doc_id").alias("packet_id"), "text", "doc_id", F.col("source").alias("section_path"))
    _, relations = evidence.expanded(packets, seeds, ignored=t.spark.createDataFrame([("de",)], "name string"))
    return relations.groupBy("source", "target", "relation_type").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- procedures


@query(
    "step_run",
    """SELECT p_partkey, p_size * 2.0 + 1 AS area, round((p_size * 2.0 + 1) / 4, 6) AS share, CASE WHEN p_partkey % 3 = 0 THEN 5.0 ELSE round(p_retailprice * 1.5, 6) END AS cost, 0.15 AS factor, 'broken' AS broken FROM part""",
)
def step_run(t: Tables) -> DataFrame:
    """A procedure over all parts: steps use earlier outputs, rows keep outputs they have, a broken step stops none."""
    run = [
        steps.Step("area", "calculator", {"expression": "w * 2 + 1", "w": "${p_size}"}, {"area": "result"}),
        steps.Step("broken", "calculator", {"expression": "x + 1", "x": "${nothing}"}, {"never": "result"}),
        steps.Step("share", "calculator", {"expression": "a / n", "a": "${area}", "n": 4}, {"share": "."}),
        steps.Step("cost", "double", {"price": "${p_retailprice}"}, {"cost": "cost"}),
        steps.Step("factor", "calculator", {"expression": "1"}, {"factor": "0.15"}),
    ]
    tools = steps.Registry()
    tools.add("double")(lambda inputs: {"cost": inputs["price"] * 1.5})
    rows = t.part.select("p_partkey", "p_size", "p_retailprice", F.when(F.col("p_partkey") % 3 == 0, 5.0).alias("cost"))
    out = steps.run(rows, run, tools)
    return out.select("p_partkey", "area", F.round("share", 6).alias("share"), F.round("cost", 6).alias("cost"), "factor", F.substring_index(F.element_at("problems", 1), ":", 1).alias("broken"))


@query(
    "step_checks",
    """WITH s AS (SELECT p_size AS sop_id, p_partkey AS step_id, CASE p_partkey % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'calculator' WHEN 2 THEN 'magic' ELSE '' END AS tool, p_partkey % 8 = 0 AS analysed, p_partkey % 5 = 0 AS bare, CASE WHEN p_partkey % 6 = 0 THEN -1 - p_partkey END AS next_id FROM part)
       SELECT step_id, 'analysed without a tool' AS problem FROM s WHERE tool = 'auto' AND analysed UNION ALL SELECT step_id, 'unknown tool' FROM s WHERE tool = 'magic' UNION ALL SELECT step_id, 'no description' FROM s WHERE bare UNION ALL SELECT step_id, 'dangling' FROM s WHERE next_id IS NOT NULL""",
)
def step_checks(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    tool = F.when(key % 4 == 0, "auto").when(key % 4 == 1, "calculator").when(key % 4 == 2, "magic").otherwise("")
    rows = t.part.select(F.col("p_size").alias("sop_id"), F.lit(0).alias("place"), key.alias("step_id"), tool.alias("tool"), (key % 8 == 0).alias("analysed"), F.when(key % 6 == 0, -1 - key).alias("next_step_id"), F.when(key % 5 == 0, " ").otherwise("does it").alias("description"))
    return steps.step_problems(rows, steps.TOOLS.names()).select("step_id", "problem")


@query("missing_inputs", "SELECT p_partkey AS sop_id, CASE WHEN p_partkey % 2 = 0 THEN 'b' ELSE 'c' END AS key FROM part WHERE p_partkey % 3 > 0")
def missing_inputs(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    rows = t.part.select(key.alias("sop_id"), F.create_map(F.lit("x"), F.lit("${a.first} and ${d}")).alias("inputs"), F.create_map(F.when(key % 3 == 0, F.when(key % 2 == 0, "b").otherwise("c")).otherwise("z"), F.lit("result")).alias("outputs"))
    required = t.part.select(key.alias("sop_id"), F.explode(F.array(F.lit("user_query"), F.lit("a"), F.lit("d"), F.when(key % 2 == 0, "b").otherwise("c"))).alias("key"))
    return steps.missing_inputs(rows, required)


@query(
    "step_templates",
    """WITH n AS (SELECT p_size AS path_id, p_partkey AS place, p_name AS name, CASE p_partkey % 3 WHEN 0 THEN 'action' ELSE 'concept' END AS layer FROM part),
       m AS (SELECT *, CASE WHEN layer <> 'concept' OR coalesce(lag(layer) OVER w, '') <> 'concept' THEN 1 ELSE 0 END AS b FROM n WINDOW w AS (PARTITION BY path_id ORDER BY place)), s AS (SELECT *, CAST(sum(b) OVER (PARTITION BY path_id ORDER BY place) AS BIGINT) AS step FROM m)
       SELECT path_id, step AS place, string_agg(name, ',' ORDER BY s.place) AS names, min(layer) AS layer FROM s GROUP BY path_id, step""",
)
def step_templates(t: Tables) -> DataFrame:
    nodes = t.part.select(F.col("p_size").alias("path_id"), F.col("p_partkey").alias("place"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 3 == 0, "action").otherwise("concept").alias("layer"))
    return steps.step_template(nodes).select("path_id", "place", F.array_join("names", ",").alias("names"), "layer")


# ---------------------------------------------------------------- evaluation


@query(
    "retrieval_rows",
    """SELECT doc_id AS question_id, doc_id % 4 <> 0 AS evaluated, CASE WHEN doc_id % 4 <> 0 THEN CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.0 END END AS score FROM documents""",
)
def retrieval_rows(t: Tables) -> DataFrame:
    key = F.col("doc_id")
    gold = F.when(key % 4 != 0, F.array(F.lit("A / B"))).otherwise(F.array().cast("array<string>"))
    paths = F.array(F.lit("C"), F.when(key % 3 == 0, "A / B / D").otherwise("E"))
    return evaluate.EVALUATORS["retrieval"](t.documents.select(key.alias("question_id"), paths.alias("paths"), gold.alias("gold"))).select("question_id", "evaluated", "score")


@query(
    "sql_scores",
    """SELECT o_orderkey AS question_id, o_orderstatus = 'F' AS execution_success, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 = 1 END AS sql_exact_match, CAST(o_orderkey % 2 = 0 OR o_orderkey % 5 = 0 AS BOOLEAN) AS cited FROM orders""",
)
def sql_scores(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    runs = t.orders.select(key.alias("question_id"), F.when(F.col("o_orderstatus") == "F", "success").otherwise("error").alias("execution_status"), F.lit("SELECT 1 ").alias("generated_sql"), F.when(key % 3 == 0, "").when(key % 3 == 1, "SELECT 1").otherwise("SELECT 2").alias("expected_sql"))
    cited = evaluate.cites_sections(F.when(key % 2 == 0, F.array(F.lit("A /B/ C"))).otherwise(F.array(F.lit("D"))), F.when(key % 5 == 0, F.array(F.lit(" "))).otherwise(F.array(F.lit("B / C"))))
    return evaluate.EVALUATORS["text2sql"](runs).drop("score").join(t.orders.select(key.alias("question_id"), cited.alias("cited")), "question_id")


@query("score_changes", "SELECT event_type AS metric, round(coalesce(avg(value) FILTER (WHERE user_id % 2 = 1), 0) - coalesce(avg(value) FILTER (WHERE user_id % 2 = 0), 0), 4) AS change FROM events GROUP BY event_type")
def score_changes(t: Tables) -> DataFrame:
    run = lambda r: t.events.where(F.col("user_id") % 2 == r).groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    return evaluate.score_changes(run(0), run(1))


@query("case_summary", "SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS passed, count(*) FILTER (WHERE o_orderstatus = 'O') AS failed, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS skipped FROM orders")
def case_summary(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "passed").when(F.col("o_orderstatus") == "O", "failed").otherwise("skipped")
    return evaluate.case_summary(t.orders.select(status.alias("status")))


@query(
    "run_progress",
    """SELECT c_custkey AS run_id, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, round(count(*) FILTER (WHERE o_orderstatus = 'F') / 20, 6) AS share, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS mean_score FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
)
def run_progress(t: Tables) -> DataFrame:
    details = t.orders.select(F.col("o_custkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("running").alias("status"), F.col("o_totalprice").alias("score"))
    out = evaluate.progress(t.customer.select(F.col("c_custkey").alias("run_id"), F.lit(20).alias("total")), details)
    return out.select("run_id", "done", F.round("share", 6).alias("share"), F.round("mean_score", 4).alias("mean_score"))


# ---------------------------------------------------------------- graph and trees


@query("tree_children", f"WITH {NODES_SQL} SELECT node_id, sort_order FROM nodes WHERE parent_id = 'r2'")
def tree_children(t: Tables) -> DataFrame:
    return graph.children(tree_nodes(t), "r2").select("node_id", "sort_order")


@query(
    "tree_insert",
    f"""WITH {NODES_SQL}, new AS (SELECT 'x' || s_suppkey AS node_id, 'n' || s_nationkey AS parent_id, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE -1 END AS sort_order FROM supplier),
        last AS (SELECT parent_id, max(sort_order) AS m FROM nodes GROUP BY 1)
        SELECT node_id, sort_order FROM nodes UNION ALL SELECT node_id, CASE WHEN sort_order < 0 THEN coalesce(m, -1) + row_number() OVER (PARTITION BY new.parent_id, sort_order < 0 ORDER BY node_id) ELSE sort_order END FROM new LEFT JOIN last USING (parent_id)""",
)
def tree_insert(t: Tables) -> DataFrame:
    new = t.supplier.selectExpr("concat('x', s_suppkey) AS node_id", "concat('n', s_nationkey) AS parent_id", "s_name AS title", "CAST(CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE -1 END AS BIGINT) AS sort_order")
    return graph.inserted(tree_nodes(t), new).select("node_id", "sort_order")


@query(
    "tree_move",
    f"""WITH {NODES_SQL}, m AS (SELECT *, CASE WHEN node_id LIKE 's%' AND TRY_CAST(substr(node_id, 2) AS BIGINT) % 10 = 3 THEN 'n0' ELSE parent_id END AS dest, node_id LIKE 's%' AND TRY_CAST(substr(node_id, 2) AS BIGINT) % 10 = 3 AS moves FROM nodes),
        touched AS (SELECT parent_id AS k FROM m WHERE moves UNION SELECT 'n0' WHERE EXISTS (SELECT 1 FROM m WHERE moves))
        SELECT node_id, dest AS parent_id, CASE WHEN coalesce(dest, '') IN (SELECT k FROM touched) THEN row_number() OVER (PARTITION BY dest ORDER BY moves, sort_order, node_id) - 1 ELSE sort_order END AS sort_order FROM m""",
)
def tree_move(t: Tables) -> DataFrame:
    moves = t.supplier.where("s_suppkey % 10 = 3").selectExpr("concat('s', s_suppkey) AS node_id", "'n0' AS parent_id")
    return graph.moved(tree_nodes(t), moves).select("node_id", "parent_id", "sort_order")


@query(
    "delete_preview",
    f"""WITH RECURSIVE {NODES_SQL}, walk AS (SELECT node_id, title FROM nodes WHERE node_id = 'r2' UNION ALL SELECT n.node_id, n.title FROM nodes n JOIN walk w ON n.parent_id = w.node_id)
        SELECT count(*) AS total_nodes, count(*) FILTER (WHERE node_id NOT LIKE 's%') AS folder_count, count(*) FILTER (WHERE node_id LIKE 's%') AS document_count, (SELECT string_agg(title, ',' ORDER BY title) FROM (SELECT title FROM walk WHERE node_id LIKE 's%' ORDER BY title, node_id LIMIT 5)) AS titles FROM walk""",
)
def delete_preview(t: Tables) -> DataFrame:
    shown = graph.delete_preview(tree_nodes(t), "r2", folder=~F.col("node_id").startswith("s"))
    return shown.withColumn("titles", F.array_join("titles", ","))


@query("soft_delete", f"WITH RECURSIVE {NODES_SQL}, walk AS (SELECT node_id FROM nodes WHERE node_id = 'n3' UNION ALL SELECT n.node_id FROM nodes n JOIN walk w ON n.parent_id = w.node_id) SELECT node_id, node_id IN (SELECT node_id FROM walk) AS deleted FROM nodes")
def soft_delete(t: Tables) -> DataFrame:
    return graph.soft_deleted(tree_nodes(t).withColumn("deleted", F.lit(False)), "n3").select("node_id", "deleted")


@query(
    "outline",
    """WITH {blocks} SELECT 'outline:' || block_id AS outline_id, trim(text) AS title, title_level AS level, CASE WHEN page_idx > 0 AND lead_text <> '' THEN 'outline:' || doc_id || ':' || (pos - 20) END AS parent_outline_id FROM (SELECT *, lag(trim(text)) OVER (PARTITION BY doc_id ORDER BY pos) AS lead_text FROM blocks WHERE block_type = 'title') WHERE trim(text) <> ''""",
)
def outline(t: Tables) -> DataFrame:
    parent = F.when(F.col("page_idx") > 0, F.concat_ws(":", "doc_id", F.col("pos") - 20))
    return graph.outlines(t.blocks.withColumn("parent_id", parent)).select("outline_id", "title", "level", "parent_outline_id")


@query(
    "tombstones",
    """SELECT s_suppkey AS entity_id, 'kept' AS state FROM supplier WHERE s_nationkey % 5 <> 2 UNION ALL SELECT s_suppkey, 'deleted' FROM supplier WHERE s_nationkey % 5 = 2 AND s_suppkey % 2 = 0
       UNION ALL SELECT n_nationkey, 'edge' FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_nationkey % 5 <> 2)""",
)
def tombstones(t: Tables) -> DataFrame:
    """Suppliers of some nations are deleted with their edges and remembered; every other one may come back."""
    entities = t.supplier.select(F.col("s_suppkey").cast("string").alias("entity_id"), F.lit("lib").alias("library_id"), F.col("s_name").alias("name"), "s_nationkey")
    edges = t.supplier.select(F.col("s_suppkey").cast("string").alias("source_id"), F.concat(F.lit("n"), "s_nationkey").alias("target_id"))
    none = t.spark.createDataFrame([], "library_id string, name string, deleted_at timestamp")
    kept, left, dead = graph.removed(entities.drop("s_nationkey"), edges, none, entities.where("s_nationkey % 5 = 2"), F.lit("2024-01-01").cast("timestamp"))
    dead = graph.restored(dead, entities.where("CAST(entity_id AS BIGINT) % 2 = 1"))
    gone = entities.join(graph.without_deleted(entities, dead).select("entity_id"), "entity_id", "left_anti")
    number = lambda c: F.regexp_replace(c, "^n", "").cast("long").alias("entity_id")
    parts = [kept.select(number("entity_id"), F.lit("kept").alias("state")), gone.select(number("entity_id"), F.lit("deleted").alias("state")), left.select(number("target_id"), F.lit("edge").alias("state")).distinct()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "alias_merge",
    """WITH m AS (SELECT s_suppkey AS loser, s_suppkey - 1 AS keeper FROM supplier WHERE s_suppkey % 4 = 1 AND s_suppkey - 1 IN (SELECT s_suppkey FROM supplier))
       SELECT s.s_suppkey AS entity_id, array_to_string(list_sort(list_distinct(['S' || s.s_suppkey] || CASE WHEN l.s_suppkey IS NULL THEN [] ELSE [l.s_name, 'S' || l.s_suppkey] END)), ',') AS aliases FROM supplier s LEFT JOIN m ON keeper = s.s_suppkey LEFT JOIN supplier l ON l.s_suppkey = loser WHERE s.s_suppkey NOT IN (SELECT loser FROM m)""",
)
def alias_merge(t: Tables) -> DataFrame:
    entities = t.supplier.select(F.col("s_suppkey").cast("string").alias("entity_id"), F.col("s_name").alias("name"), F.array(F.concat(F.lit("S"), "s_suppkey")).alias("aliases"))
    known = t.supplier.select(F.col("s_suppkey").cast("string").alias("keeper"))
    merges = t.supplier.where("s_suppkey % 4 = 1").select(F.col("s_suppkey").cast("string").alias("loser"), (F.col("s_suppkey") - 1).cast("string").alias("keeper")).join(known, "keeper", "left_semi")
    edges = t.supplier.select(F.col("s_suppkey").cast("string").alias("source_id"), F.lit("n").alias("target_id"))
    kept, _ = graph.merged_entities(entities, edges, merges)
    return kept.select(F.col("entity_id").cast("long").alias("entity_id"), F.array_join("aliases", ",").alias("aliases"))


@query("bridge_join", "SELECT DISTINCT p_partkey FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = 3")
def bridge_join(t: Tables) -> DataFrame:
    """Parts that a bridge of order lines ties to the suppliers of a nation."""
    bridge = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("entity_id"))
    return graph.bridged(t.part, bridge, t.supplier.where("s_nationkey = 3").select(F.col("s_suppkey").alias("entity_id")), "p_partkey").select("p_partkey")


@query("entity_listing", "WITH {edges} SELECT DISTINCT doc_id, 'doc' AS kind FROM edges WHERE source_id = 'nation-7' OR target_id = 'nation-7' UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'entity' FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7")
def entity_listing(t: Tables) -> DataFrame:
    rows = t.customer.select(F.col("c_custkey").cast("string").alias("doc_id"), F.col("c_mktsegment").alias("layer"), F.col("c_nationkey").alias("library_id"), F.lit("entity").alias("kind"))
    return graph.documents_of(t.edges, "nation-7").withColumn("kind", F.lit("doc")).unionByName(graph.listed(rows.withColumn("library_id", F.col("library_id").cast("string")), layer="BUILDING", library="7").select("doc_id", "kind"))


@query(
    "glossary_notes",
    """SELECT n_nationkey, CASE WHEN n_regionkey % 2 = 0 THEN 'about ' || n_name || chr(10) || 'more' ELSE 'about ' || n_name END AS description, CASE WHEN n_regionkey % 2 = 0 THEN 'N' || n_nationkey || ',alias' ELSE 'N' || n_nationkey END AS aliases, CASE WHEN n_nationkey % 3 = 0 THEN -1.0 ELSE 0.5 END AS confidence FROM nation""",
)
def glossary_notes(t: Tables) -> DataFrame:
    entities = t.nation.select("n_nationkey", F.col("n_name").alias("name"), F.concat(F.lit("about "), "n_name").alias("description"), F.array(F.concat(F.lit("N"), "n_nationkey")).alias("aliases"))
    notes = t.nation.where("n_regionkey % 2 = 0").select(F.col("n_name").alias("name"), F.lit("more").alias("note"), F.array(F.lit("alias")).alias("aliases"))
    told = edits.noted(entities, notes).select("n_nationkey", "description", F.array_join("aliases", ",").alias("aliases"))
    relations = t.nation.select(F.col("n_nationkey").alias("relation_id"), F.lit(0.5).alias("confidence"), F.lit(None).cast("string").alias("conflict_note"))
    marked = edits.conflicting(relations, t.nation.where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("relation_id"), F.lit("differs").alias("note")))
    return told.join(marked.select(F.col("relation_id").alias("n_nationkey"), "confidence"), "n_nationkey")


@query(
    "corrections",
    """SELECT user_id AS block_id, event_type AS operation, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS payload FROM events WHERE user_id % 5 <> 0 GROUP BY 1, 2""",
)
def corrections(t: Tables) -> DataFrame:
    log = t.events.select((F.col("user_id") % 5).alias("doc_id"), F.col("user_id").alias("block_id"), F.col("event_type").alias("operation"), F.col("event_id").alias("payload"), F.struct("ts", "event_id").alias("created_at"))
    clear = edits.cleared(log, t.spark.range(1).select((F.col("id")).alias("doc_id")))
    return edits.corrections_of(clear).select("block_id", "operation", "payload")


@query(
    "link_instructions",
    """WITH b AS (SELECT p_partkey AS id, p_size AS page, CASE WHEN p_partkey % 4 = 1 THEN p_partkey + 1 ELSE -1 END AS contd, CASE WHEN p_partkey % 4 = 2 THEN p_partkey + 1 WHEN p_partkey % 4 = 3 THEN p_partkey - 1 ELSE -1 END AS merge FROM part),
       l AS (SELECT CASE WHEN contd >= 0 THEN 'contd' ELSE 'table_merge' END AS kind, id, page, CASE WHEN contd >= 0 THEN contd ELSE merge END AS other FROM b WHERE contd >= 0 OR merge >= 0)
       SELECT l.kind, 'u' || l.id AS source_uid, 'u' || l.other AS target_uid FROM l JOIN b o ON o.id = l.other LEFT JOIN l r ON r.kind = 'table_merge' AND l.kind = 'table_merge' AND r.id = l.other AND r.other = l.id WHERE r.id IS NULL OR (l.page, l.id) < (r.page, r.id)""",
)
def link_instructions(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    rows = t.part.select(key.alias("id"), F.concat(F.lit("u"), key).alias("source_uid"), F.col("p_size").alias("page"), F.when(key % 4 == 1, key + 1).otherwise(-1).alias("contd"), F.when(key % 4 == 2, key + 1).when(key % 4 == 3, key - 1).otherwise(-1).alias("table_merge"))
    return edits.link_instructions(rows)


@query(
    "signal_levels",
    """WITH {blocks} SELECT block_id, CASE WHEN page_idx % 2 = 0 THEN page_idx % 4 + 1 ELSE 3 END AS level FROM blocks WHERE block_type = 'title'""",
)
def signal_levels(t: Tables) -> DataFrame:
    own = t.blocks.withColumn("source_id", F.when(F.col("page_idx") % 2 == 0, F.col("page_idx") % 4)).withColumn("text", F.when(F.col("block_type") == "title", F.lit(" One  Title ")).otherwise(F.col("text")))
    titles = t.spark.createDataFrame([(0, "x", 1, 1), (2, "y", 3, 2), (None, "OneTitle", 3, 3), (None, "One Title", 5, 4), (None, "z", 0, 5)], "source_id long, title string, level long, place int")
    return edits.signal_levels(own, titles)
