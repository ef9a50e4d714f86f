"""Readers of parsed documents, evaluation bundles and step catalogues, each with its schema.

Files hold one JSON value each, or, with `lines`, one a line, which Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = """block_uid string, block_type string, plain_text string, page_idx int, block_seq int, derived_title_level int, title_level int, section_path string, parent_block_uid string, contd_target_id string, image_assoc_id string,
    table_merge_id string, raw_type string, document_part string, page_role string, layout_category string, page_bboxes array<struct<page_idx:int,bbox:array<double>>>, merged_from array<string>, table_html string"""
BUNDLE = """dataset struct<dataset_id:string,title:string,category:string,schema_version:string,version:string,library_id:string>, items array<struct<question_id:string,question:string,task_type:string,intent_level:string,
    doc_ids:array<string>,tags:array<string>,retrieval:struct<gold_section_paths:array<string>,gold_chunk_ids:array<string>,gold_doc_ids:array<string>,gold_target_ids:array<string>,gold_target_types:array<string>,
    hard_negative_target_ids:array<string>,must_include_terms:array<string>>,answer:struct<gold_answer:string,correctness_checks:array<struct<type:string,keywords:array<string>>>,refusal_expected:boolean>>>"""
STEPS = "sop_id string, title string, status string, steps array<struct<step_id:string,name:string,tool:string,next_step_id:string,inputs:map<string,string>,outputs:map<string,string>>>"
LAYOUT = "page_info struct<page_no:int,width:double,height:double>, layout_dets array<struct<category_id:int,poly:array<double>,score:double,text:string>>"

CONTENT = "type string, text string, text_level int, page_idx int, bbox array<double>, table_body string, img_path string, image_caption array<string>, table_caption array<string>"
MIDDLE = "pdf_info array<struct<page_idx:int,para_blocks:array<struct<type:string,lines:array<struct<spans:array<struct<content:string,score:double>>>>>>>>"
MODEL = "page_info struct<page_no:int,width:double,height:double>, layout_dets array<struct<label:string,score:double,bbox:array<double>>>"


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of document graphs, one JSON object a line; lines that don't fit the schema fail the read."""
    return spark.read.schema(NODE).option("mode", "FAILFAST").json(path)


def questions(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Questions of evaluation bundles (`eval.bundle.v2`), one row each; other schema versions are an error."""
    rows = spark.read.schema(BUNDLE).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    checked = rows.where(F.when(F.col("dataset.schema_version") == "eval.bundle.v2", True).otherwise(F.raise_error(F.lit("not an eval.bundle.v2")).cast("boolean")))
    return checked.select("dataset.dataset_id", F.explode("items").alias("q")).select("dataset_id", "q.*")


def steps(spark: SparkSession, path: str, *, status: str | None = None, lines: bool = False) -> DataFrame:
    """Steps of a catalogue of procedures in their order: (sop_id, title, status, place, step fields)."""
    rows = spark.read.schema(STEPS).option("multiLine", not lines).json(path)
    if status:
        rows = rows.where(F.col("status") == status)
    return rows.select("sop_id", "title", "status", F.posexplode("steps").alias("place", "step")).select("sop_id", "title", "status", "place", "step.*")


def layout_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Detected boxes of layout files, a page's boxes as (page_idx, category_id, score, text, x0, y0, x1, y1), relative to the page."""
    pages = spark.read.schema(LAYOUT).option("multiLine", True).json(path)
    boxes = pages.select("page_info.*", F.explode("layout_dets").alias("d"))
    corner = lambda i, side: F.get("d.poly", F.lit(i)) / F.col(side)
    return boxes.select(F.col("page_no").alias("page_idx"), "d.category_id", "d.score", "d.text", corner(0, "width").alias("x0"), corner(1, "height").alias("y0"), corner(4, "width").alias("x1"), corner(5, "height").alias("y1"))


def contents(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Entries of a parser's content list in their order: (place, type, text, text_level, page_idx, bbox, table_body, img_path, captions)."""
    files = spark.read.option("wholetext", not lines).text(path).select(F.from_json("value", f"array<struct<{', '.join(_fields(CONTENT))}>>").alias("entries"))
    rows = files.select(F.posexplode("entries").alias("place", "e")).select("place", "e.*")
    both = F.concat(F.coalesce("image_caption", F.array().cast("array<string>")), F.coalesce("table_caption", F.array().cast("array<string>")))
    return rows.withColumn("captions", both).drop("image_caption", "table_caption")


def _fields(schema: str) -> list[str]:
    """Fields of a flat schema in the form of a struct's."""
    return [": ".join(field.split(None, 1)) for field in schema.split(", ")]


def recognised_lines(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Spans of a parser's intermediate file: (page_idx, block, score); blocks without spans have a null score."""
    pages = spark.read.schema(MIDDLE).option("multiLine", not lines).json(path).select(F.explode("pdf_info").alias("p"))
    rows = pages.select("p.page_idx", F.posexplode("p.para_blocks").alias("block", "b"))
    spans = F.flatten(F.transform(F.coalesce("b.lines", F.array().cast("array<struct<spans:array<struct<content:string,score:double>>>>")), lambda line: line["spans"]))
    return rows.select("page_idx", "block", F.explode_outer(F.transform(spans, lambda s: s["score"])).alias("score"))


def model_boxes(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Boxes that a layout model found: (page_idx, label, score, x0, y0, x1, y1), relative to the page and within it; those without label,
    score or corners are left out, and pages without a size."""
    pages = spark.read.schema(MODEL).option("multiLine", not lines).json(path).where("page_info.width > 0 AND page_info.height > 0")
    rows = pages.select("page_info.*", F.explode("layout_dets").alias("d")).where("trim(d.label) <> '' AND d.score IS NOT NULL AND size(d.bbox) >= 4")
    edge = lambda i, side: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.get("d.bbox", F.lit(i)) / F.col(side)))
    return rows.select(F.col("page_no").alias("page_idx"), F.trim("d.label").alias("label"), "d.score", edge(0, "width").alias("x0"), edge(1, "height").alias("y0"), edge(2, "width").alias("x1"), edge(3, "height").alias("y1"))
