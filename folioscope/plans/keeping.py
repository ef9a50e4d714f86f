"""Documents and their indexes as they are kept: replaced whole, deleted whole, brought up to date by what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import upper_letters
from folioscope.operators.upkeep import ChunkIndexes
from folioscope.plans.ranking import LETTERS, best_texts, bm25_sql
from folioscope.plans.registry import Tables, query
from folioscope.session import work_dir
from folioscope.sources.segments import Segments, nested

#: Child tables of a document: the blocks, and those of the blocks that each of the others takes.
CHILDREN = {"blocks": "TRUE", "titles": "block_type = 'title'", "formulas": "block_type = 'formula'", "lists": "block_type = 'list_item'", "paragraphs": "block_type = 'paragraph'", "targets": "block_type IN ('title', 'formula')", "outlines": "title_level IS NOT NULL", "first_lines": "pos = 0"}

_COUNTS = ", ".join(f"count(*) FILTER ({test}) AS {name}" for name, test in CHILDREN.items())


def _children(blocks: DataFrame) -> dict[str, DataFrame]:
    return {name: blocks.where(test).select("doc_id", "pos", "block_id", "text") for name, test in CHILDREN.items()}


@query(
    "document_replace",
    f"""WITH {{blocks}}, now AS (SELECT * REPLACE (CASE WHEN lang = 'fr' THEN upper(b.text) ELSE b.text END AS text) FROM blocks b JOIN (SELECT DISTINCT doc_id, lang FROM documents) USING (doc_id) WHERE lang IS DISTINCT FROM 'de' AND (lang IS DISTINCT FROM 'fr' OR pos % 2 = 0))
        SELECT doc_id, {_COUNTS}, md5(string_agg(text, chr(10) ORDER BY pos)) AS digest FROM now GROUP BY doc_id""",
)
def document_replace(t: Tables) -> DataFrame:
    """Whole documents after all eight child tables of those in one language were replaced in one commit, and those of another deleted in all."""
    store = Segments(t.spark, work_dir(t.spark), "doc_id")
    store.commit("load", _children(t.blocks))
    french = t.documents.where("lang = 'fr'").select("doc_id")
    store.commit("replace", _children(t.blocks.where("pos % 2 = 0").withColumn("text", upper_letters(F.col("text"))).join(french, "doc_id", "left_semi")), gone=french)
    store.commit("delete", {}, gone=t.documents.where("lang = 'de'").select("doc_id"))
    children = {name: store.read(name) for name in CHILDREN}
    whole = nested(children["blocks"].select("doc_id").distinct(), children, "doc_id", {name: ["pos"] for name in CHILDREN})
    counts = [F.size(name).cast("long").alias(name) for name in CHILDREN]
    return whole.select("doc_id", *counts, F.md5(F.array_join(F.transform("blocks", lambda b: b["text"]), "\n")).alias("digest"))


UPKEPT_SQL = "FROM (SELECT doc_id, CASE WHEN lang = 'fr' THEN text || ' gnu nation ' || doc_id ELSE text END AS text FROM documents WHERE lang IS DISTINCT FROM 'de' AND text IS NOT NULL))"


@query("index_upkeep", bm25_sql(LETTERS, ["reaux", "étion", "gnu", "nation"], 1.2, 20).replace("FROM documents)", UPKEPT_SQL))
def index_upkeep(t: Tables) -> DataFrame:
    """Full-text hits after two states of the documents were indexed one after the other: what differs is found, and only that is indexed."""
    indexes = ChunkIndexes(t.spark, work_dir(t.spark), targets=lambda rows: rows.select("chunk_id", F.substring("text", 1, 180).alias("snippet")))
    first = t.documents.where("text IS NOT NULL").select(F.col("doc_id").alias("chunk_id"), "text", "lang")
    second = first.where("lang IS NULL OR lang <> 'de'").withColumn("text", F.when(F.col("lang") == "fr", F.concat_ws(" ", "text", F.lit("gnu nation"), "chunk_id")).otherwise(F.col("text")))
    indexes.apply("first", first)
    indexes.apply("second", second)
    return best_texts(indexes.text.bm25(["reaux", "étion", "gnu", "nation"]))
