"""Document structure over blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import clean
from folioscope.operators import listing, structure
from folioscope.plans.registry import Tables, query

TITLED = """titles AS (SELECT b.doc_id, b.pos, t.title_level AS lv, t.pos AS tp, t.text AS title, t.block_id AS tid, b.block_type, b.block_id, b.title_level AS own
       FROM blocks b JOIN blocks t ON t.doc_id = b.doc_id AND t.pos <= b.pos AND t.block_type = 'title' AND t.text <> ''),
    live AS (SELECT x.* FROM titles x WHERE NOT EXISTS (SELECT 1 FROM titles y WHERE y.block_id = x.block_id AND y.tp > x.tp AND y.lv <= x.lv))"""


@query(
    "section_path",
    f"""WITH {{blocks}}, {TITLED}
        SELECT block_id, string_agg(title, ' / ' ORDER BY lv) AS section_path, CASE WHEN block_type = 'title' THEN max_by(tid, lv) FILTER (WHERE lv < own) END AS parent_id FROM live GROUP BY block_id, block_type, own""",
)
def section_path(t: Tables) -> DataFrame:
    return structure.section_paths(t.blocks).where("section_path <> ''").select("block_id", "section_path", "parent_id")


@query(
    "title_parents",
    """WITH {blocks}, titles AS (SELECT * FROM blocks WHERE title_level IS NOT NULL)
       SELECT a.block_id, max_by(b.block_id, b.pos) AS parent_at FROM titles a LEFT JOIN titles b ON b.doc_id = a.doc_id AND b.pos < a.pos AND b.title_level = a.title_level - 1 GROUP BY a.block_id""",
)
def title_parents(t: Tables) -> DataFrame:
    return structure.parents(t.blocks).where("title_level IS NOT NULL").select("block_id", "parent_at")


@query("adjacency", "WITH {blocks} SELECT block_id, lag(block_id) OVER w AS prev_id, lead(block_id) OVER w AS next_id FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY pos)")
def adjacency(t: Tables) -> DataFrame:
    return structure.neighbours(t.blocks).select("block_id", "prev_id", "next_id")


@query(
    "line_ranges",
    """WITH {blocks} SELECT block_id, CAST(sum(length(text) // 80 + 2) OVER w AS BIGINT) - 1 - length(text) // 80 AS first_line, CAST(sum(length(text) // 80 + 2) OVER w AS BIGINT) - 1 AS last_line
       FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""",
)
def line_ranges(t: Tables) -> DataFrame:
    return structure.line_ranges(t.blocks, F.floor(F.char_length("text") / 80) + 1).select("block_id", "first_line", "last_line")


PAGES_SQL = """marked AS (SELECT doc_id, page_idx, reading_order, block_type, CASE WHEN page_idx = 0 AND doc_id % 3 = 0 THEN '前言' WHEN page_idx = 0 AND doc_id % 3 = 1 THEN '目次' WHEN reading_order = 0 AND page_idx >= 1 THEN clause_id || ' ' || text ELSE text END AS text FROM blocks)"""


@query(
    "page_roles",
    f"""WITH {{blocks}}, {PAGES_SQL}, pages AS (SELECT doc_id, page_idx, bool_or(contains(text, '目次') OR contains(text, '目录')) AS toc, bool_or(contains(text, '前言')) AS preface, bool_or(block_type = 'title' AND regexp_matches(text, '^[0-9]+(\\.[0-9]+)*\\s')) AS numbered FROM marked GROUP BY 1, 2),
        starts AS (SELECT *, min(CASE WHEN numbered AND NOT toc THEN page_idx END) OVER (PARTITION BY doc_id) AS start FROM pages),
        roles AS (SELECT doc_id, page_idx, CASE WHEN start IS NOT NULL AND page_idx >= start THEN CASE WHEN toc THEN 'toc' ELSE 'body' END WHEN toc THEN 'toc' WHEN preface THEN 'preface' WHEN page_idx = 0 THEN 'cover' ELSE 'unknown' END AS role FROM starts)
        SELECT *, CASE role WHEN 'body' THEN 'body' WHEN 'unknown' THEN 'unknown' ELSE 'front_matter' END AS part FROM roles""",
)
def page_roles(t: Tables) -> DataFrame:
    first = F.col("page_idx") == 0
    text = F.when(first & (F.col("doc_id") % 3 == 0), "前言").when(first & (F.col("doc_id") % 3 == 1), "目次").when((F.col("reading_order") == 0) & ~first, F.concat_ws(" ", "clause_id", "text")).otherwise(F.col("text"))
    return structure.page_roles(t.blocks.withColumn("text", text))


@query(
    "formula_context",
    """WITH {blocks} SELECT f.block_id, coalesce(string_agg(b.text, '|' ORDER BY b.pos) FILTER (WHERE b.pos < f.pos), '') AS before, coalesce(string_agg(b.text, '|' ORDER BY b.pos) FILTER (WHERE b.pos > f.pos), '') AS after
       FROM blocks f LEFT JOIN blocks b ON b.doc_id = f.doc_id AND b.page_idx = f.page_idx AND b.pos BETWEEN f.pos - 4 AND f.pos + 4 AND b.block_type IN ('paragraph', 'list_item') WHERE f.block_type = 'formula' GROUP BY f.block_id""",
)
def formula_context(t: Tables) -> DataFrame:
    return structure.formula_context(t.blocks).select("block_id", F.array_join("before", "|").alias("before"), F.array_join("after", "|").alias("after"))


@query(
    "explain_links",
    """WITH {blocks} SELECT p.block_id, max_by(f.block_id, f.pos) AS formula_id FROM blocks p JOIN blocks f ON f.doc_id = p.doc_id AND f.page_idx = p.page_idx AND f.pos BETWEEN p.pos - 7 AND p.pos - 1 AND f.block_type = 'formula'
       WHERE p.block_type = 'paragraph' AND NOT EXISTS (SELECT 1 FROM blocks s WHERE s.doc_id = p.doc_id AND s.page_idx = p.page_idx AND s.block_type = 'title' AND s.pos < p.pos AND s.pos > f.pos AND s.pos >= p.pos - 7) GROUP BY p.block_id""",
)
def explain_links(t: Tables) -> DataFrame:
    return structure.explains(t.blocks)


@query(
    "page_continuations",
    """WITH {blocks}, typed AS (SELECT *, CASE WHEN doc_id % 2 = 0 AND (pos % 20 IN (0, 19)) THEN 'table' ELSE block_type END AS kind FROM blocks),
       edges AS (SELECT doc_id, page_idx, max_by(block_id, pos) AS last_id, max_by(kind, pos) AS last_kind, min_by(block_id, pos) AS first_id, min_by(kind, pos) AS first_kind FROM typed GROUP BY 1, 2)
       SELECT a.doc_id, a.page_idx, a.last_id AS from_id, b.first_id AS to_id FROM edges a JOIN edges b ON b.doc_id = a.doc_id AND b.page_idx = a.page_idx + 1 WHERE a.last_kind = 'table' AND b.first_kind = 'table'""",
)
def page_continuations(t: Tables) -> DataFrame:
    kind = F.when((F.col("doc_id") % 2 == 0) & (F.col("pos") % 20).isin(0, 19), "table").otherwise(F.col("block_type"))
    return structure.continuations(t.blocks.withColumn("block_type", kind), "table")


@query("resequence_blocks", "WITH {blocks} SELECT block_id, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY length(text) DESC, block_id) AS seq FROM blocks")
def resequence_blocks(t: Tables) -> DataFrame:
    return structure.resequenced(t.blocks, ["doc_id", "page_idx"], [F.desc(F.char_length("text")), F.col("block_id")], first=1).select("block_id", "seq")


@query(
    "contents_islands",
    """WITH {blocks}, pages AS (SELECT doc_id, page_idx FROM blocks GROUP BY 1, 2 HAVING avg(CASE WHEN contains(text, '.') AND length(text) % 2 = 0 THEN 1.0 ELSE 0.0 END) > 0.5),
       rows AS (SELECT *, page_idx - row_number() OVER (PARTITION BY doc_id ORDER BY page_idx) AS island FROM pages)
       SELECT doc_id, island, min(page_idx) AS first_page, max(page_idx) AS last_page FROM rows GROUP BY 1, 2""",
)
def contents_islands(t: Tables) -> DataFrame:
    return structure.contents_islands(t.blocks, F.contains("text", F.lit(".")) & (F.char_length("text") % 2 == 0))


@query(
    "citation_targets",
    r"""WITH {blocks} SELECT block_id AS target_id, block_type AS target_type, page_idx, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 32) AS display_title, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 180) AS snippet FROM blocks WHERE block_type IN ('title', 'formula')""",
)
def citation_targets(t: Tables) -> DataFrame:
    return structure.citation_targets(t.blocks)


CHUNK_WALK_SQL = rf"""WITH RECURSIVE {{blocks}}, {TITLED}, sections AS (SELECT block_id, string_agg(title, ' / ' ORDER BY lv) AS section FROM live GROUP BY block_id),
    b AS (SELECT doc_id, block_id, block_type AS kind, page_idx, coalesce(section, '') AS section, plain, length(plain) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i
          FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS plain FROM blocks) LEFT JOIN sections USING (block_id) WHERE plain <> ''),
    walk AS (
        SELECT *, 1 AS chunk, n AS total, kind = 'formula' AS formula, section AS first_section FROM b WHERE i = 1
        UNION ALL
        SELECT doc_id, block_id, kind, page_idx, section, plain, n, i, chunk + CASE WHEN fresh THEN 1 ELSE 0 END, CASE WHEN fresh THEN n ELSE total + 1 + n END, kind = 'formula' OR (formula AND NOT fresh), CASE WHEN fresh THEN section ELSE first_section END
        FROM (SELECT *, held = 'title' OR kind = 'title' OR page_idx - held_page > 1 OR (NOT follows AND (section <> first_section OR greatest(1, (total + 1 + n) // 4) > 260)) AS fresh
              FROM (SELECT b.*, w.chunk, w.total, w.formula, w.first_section, w.kind AS held, w.page_idx AS held_page, b.kind = 'paragraph' AND w.formula AS follows FROM walk w JOIN b ON b.doc_id = w.doc_id AND b.i = w.i + 1)))
    SELECT doc_id, 'chunk-' || arg_min(block_id, i) AS chunk_id, CASE WHEN bool_or(kind = 'title') THEN 'outline_anchor' WHEN lead(bool_or(kind = 'title')) OVER (PARTITION BY doc_id ORDER BY chunk) THEN 'content' WHEN bool_or(kind = 'formula') THEN 'formula_block' WHEN 2 * count(*) FILTER (kind = 'list_item') > count(*) THEN 'list_procedure' ELSE 'content' END AS chunk_type,
           count(*) AS n_blocks, CAST(greatest(1, (sum(n) + count(*) - 1) // 4) AS BIGINT) AS token_count, arg_min(page_idx, i) AS page_start, max(page_idx) AS page_end, string_agg(plain, chr(10) ORDER BY i) AS text FROM walk GROUP BY doc_id, chunk"""


@query("chunk_assembly", CHUNK_WALK_SQL)
def chunk_assembly(t: Tables) -> DataFrame:
    return structure.chunk_assembly(structure.section_paths(t.blocks))


@query(
    "packet_packing",
    """WITH RECURSIVE {blocks}, i AS (SELECT doc_id, block_id, pos, CAST(length(text) AS BIGINT) AS size FROM blocks),
       walk AS (SELECT doc_id, block_id, pos, size, size AS used, CAST(0 AS BIGINT) AS packet FROM i WHERE pos = 0
                UNION ALL SELECT i.doc_id, i.block_id, i.pos, i.size, CASE WHEN used > 0 AND used + i.size > 2000 THEN i.size ELSE used + i.size END, CASE WHEN used > 0 AND used + i.size > 2000 THEN packet + 1 ELSE packet END FROM walk w JOIN i ON i.doc_id = w.doc_id AND i.pos = w.pos + 1)
       SELECT doc_id, block_id, pos, size, packet FROM walk""",
)
def packet_packing(t: Tables) -> DataFrame:
    items = t.blocks.select("doc_id", "block_id", "pos", F.char_length("text").cast("long").alias("size"))
    return structure.packed(items, "doc_id", "pos", "size", most=2000)


@query("page_synthesis", "WITH {blocks} SELECT doc_id, unnest(range(max(page_idx) + 1)) AS page_idx FROM blocks GROUP BY doc_id")
def page_synthesis(t: Tables) -> DataFrame:
    return listing.page_numbers(t.blocks)


@query(
    "vector_records",
    r"""WITH {blocks} SELECT 'chunk:' || block_id AS record_id, 'chunk' AS entity_type, trim(regexp_replace(text, '\s+', ' ', 'g')) AS content FROM blocks WHERE block_type = 'paragraph'
        UNION ALL SELECT 'formula:' || block_id, 'formula', trim(regexp_replace(text, '\s+', ' ', 'g')) FROM blocks WHERE block_type = 'formula'
        UNION ALL SELECT 'row:' || p_partkey, 'table_row_key', p_name || ' ' || p_brand FROM part""",
)
def vector_records(t: Tables) -> DataFrame:
    body = clean(F.col("text"))
    chunks = listing.vector_records(t.blocks.where("block_type = 'paragraph'"), "chunk", "chunk", "block_id", body)
    formulas = listing.vector_records(t.blocks.where("block_type = 'formula'"), "formula", "formula", "block_id", body)
    return chunks.unionByName(formulas).unionByName(listing.vector_records(t.part, "row", "table_row_key", "p_partkey", F.concat_ws(" ", "p_name", "p_brand")))
