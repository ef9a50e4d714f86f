"""Boxes and pages: overlaps, nearest centres, positional alignment, captions, split pages."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.terms import structure_level
from folioscope.functions.text import match_form

BOX = ("x0", "y0", "x1", "y1")


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (structs of x0, y0, x1, y1); 0 for empty ones."""
    side = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0.0))
    area = lambda x: F.greatest(x["x1"] - x["x0"], F.lit(0.0)) * F.greatest(x["y1"] - x["y0"], F.lit(0.0))
    common = side("x0", "x1") * side("y0", "y1")
    union = area(a) + area(b) - common
    return F.when(union > 0, common / union).otherwise(0.0)


def aligned(left: DataFrame, right: DataFrame, *, least: float = 0.95) -> DataFrame:
    """(doc_id, ordinal, left_id, right_id, agrees): the k-th block of one side with the k-th of the other; they agree if page and box do."""
    order = Window.partitionBy("doc_id").orderBy("page_idx", "reading_order")
    a = left.select("doc_id", F.row_number().over(order).cast("long").alias("ordinal"), F.struct("block_id", "page_idx", *BOX).alias("a"))
    b = right.select("doc_id", F.row_number().over(order).cast("long").alias("ordinal"), F.struct("block_id", "page_idx", *BOX).alias("b"))
    both = a.join(b, ["doc_id", "ordinal"], "full_outer")
    agrees = F.coalesce((F.col("a.page_idx") == F.col("b.page_idx")) & (iou(F.col("a"), F.col("b")) >= least), F.lit(False))
    return both.select("doc_id", "ordinal", F.col("a.block_id").alias("left_id"), F.col("b.block_id").alias("right_id"), agrees.alias("agrees"))


def nearest_centres(boxes: DataFrame, others: DataFrame, *, within: float = 0.05) -> DataFrame:
    """(block_id, other_id): for each box the other of its page with the nearest centre, if near enough."""
    centre = lambda p: ((F.col(f"{p}.x0") + F.col(f"{p}.x1")) / 2, (F.col(f"{p}.y0") + F.col(f"{p}.y1")) / 2)
    pairs = boxes.alias("a").join(others.alias("b"), ["doc_id", "page_idx"])
    (ax, ay), (bx, by) = centre("a"), centre("b")
    distance = (ax - bx) ** 2 + (ay - by) ** 2
    near = pairs.select(F.col("a.block_id").alias("block_id"), F.col("b.block_id").alias("other_id"), distance.alias("d")).where(F.col("d") <= within * within)
    return near.groupBy("block_id").agg(F.min_by("other_id", F.struct("d", "other_id")).alias("other_id"))


def captions(blocks: DataFrame, media: DataFrame) -> DataFrame:
    """(block_id, media_id): short texts of a page that hold the needle of a media block, both in match form."""
    texts = blocks.select("doc_id", "page_idx", "block_id", match_form(F.col("text")).alias("form"))
    needles = media.select("doc_id", "page_idx", F.col("block_id").alias("media_id"), match_form(F.col("needle")).alias("needle")).where("needle <> ''")
    return texts.join(needles, ["doc_id", "page_idx"]).where(F.contains("form", F.col("needle")) & (F.col("block_id") != F.col("media_id"))).select("block_id", "media_id")


# Types that are never a caption, types that may be headings, and how captions begin.
NO_CAPTIONS = ("image", "table", "header", "footer", "page_header", "page_number")
HEADING_TYPES = ("paragraph", "list", "list_item")
CAPTION_START = "(?i)^(图|表|figure|table)[0-9a-z\u4e00-\u9fa5]"


def related_blocks(blocks: DataFrame, media: DataFrame) -> DataFrame:
    """(media_id, role, block_id): blocks of a page that repeat a caption or a footnote of an image or table on it.

    media: doc_id, page_idx, block_id, captions, footnotes (arrays of texts). Other media, furniture and what reads like a heading are left
    out. In match form, a block holds such a text of two characters or more, or is a part of it of ten or more, or begins like a caption as it does.
    """
    kind = F.lower(F.trim(F.coalesce("block_type", F.lit(""))))
    heading = (kind == "title") | (kind.isin(*HEADING_TYPES) & structure_level(F.col("text")).isNotNull())
    texts = blocks.where(~kind.isin(*NO_CAPTIONS) & ~heading & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    texts = texts.select("doc_id", "page_idx", "block_id", match_form(F.trim("text")).alias("form")).where("form <> ''")
    none = F.array().cast("array<string>")
    needles = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(c, none), match_form), lambda x: F.char_length(x) >= 2))
    asked = media.select("doc_id", "page_idx", F.col("block_id").alias("media_id"), F.inline(F.array(F.struct(F.lit("caption").alias("role"), needles("captions").alias("needles")), F.struct(F.lit("footnote").alias("role"), needles("footnotes").alias("needles")))))
    form = F.col("form")
    hit = F.exists("needles", lambda n: F.contains(form, n) | ((F.char_length(form) >= 10) & F.contains(n, form)) | (form.rlike(CAPTION_START) & F.startswith(n, F.substring(form, 1, 32))))
    return texts.join(asked.where(F.size("needles") > 0), ["doc_id", "page_idx"]).where(hit & (F.col("block_id") != F.col("media_id"))).select("media_id", "role", "block_id")


def split_paragraphs(blocks: DataFrame, *, bottom: float = 0.80, top: float = 0.35) -> DataFrame:
    """(doc_id, page_idx, from_id, to_id, text): a page's last paragraph that ends without a stop at its foot, with the one that
    begins the next page at its head, their texts joined."""
    rows = blocks.where("block_type = 'paragraph'")
    edge = rows.groupBy("doc_id", "page_idx").agg(F.max_by(F.struct("block_id", "text", "y1"), "reading_order").alias("last"), F.min_by(F.struct("block_id", "text", "y0"), "reading_order").alias("first"))
    after = edge.select("doc_id", (F.col("page_idx") - 1).alias("page_idx"), F.col("first").alias("next"))
    pairs = edge.join(after, ["doc_id", "page_idx"]).where((F.col("last.y1") >= bottom) & (F.col("next.y0") <= top) & ~F.col("last.text").rlike("[.。!！?？:：;；]\\s*$"))
    return pairs.select("doc_id", "page_idx", F.col("last.block_id").alias("from_id"), F.col("next.block_id").alias("to_id"), F.concat("last.text", "next.text").alias("text"))


def resolved_boxes(blocks: DataFrame, candidates: DataFrame, *, least: float = 0.74) -> DataFrame:
    """(block_id, candidate_id, score): each block's best layout candidate of its page by text, each candidate used once.

    1.0 for equal texts, 0.72 and a quarter of the shorter share for containment, 0.04 more for the expected kind.
    Which candidate is left depends on those taken before, so pages are worked through in order, those of a task one after the other; pairs are scored in Spark.
    """
    a = blocks.select("doc_id", "page_idx", "block_id", "reading_order", "block_type", match_form(F.col("text")).alias("a")).where("a <> ''")
    b = candidates.select("doc_id", "page_idx", "candidate_id", F.col("block_type").alias("kind"), match_form(F.col("text")).alias("b")).where("b <> ''")
    pairs = a.join(b, ["doc_id", "page_idx"])
    shorter, longer = F.least(F.char_length("a"), F.char_length("b")), F.greatest(F.char_length("a"), F.char_length("b"))
    score = F.when(F.col("a") == F.col("b"), 1.0).when(F.contains("a", F.col("b")) | F.contains("b", F.col("a")), 0.72 + 0.24 * shorter / longer).otherwise(0.0)
    score = score + F.when(F.col("block_type") == F.col("kind"), 0.04).otherwise(0.0)
    near = pairs.withColumn("score", F.round(score, 6)).where(F.col("score") >= least).select("doc_id", "page_idx", "block_id", "reading_order", "candidate_id", "score")

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, served = set(), None
        for batch in batches:
            keep = []
            for place, reading_order, candidate in zip(*(batch.column(c).to_pylist() for c in ("_place", "reading_order", "candidate_id"))):
                if place == 1:
                    used, served = set(), None
                keep.append(reading_order is not None and reading_order != served and candidate not in used)
                if keep[-1]:
                    used.add(candidate)
                    served = reading_order
            yield batch.select(["block_id", "candidate_id", "score"]).filter(pa.array(keep, pa.bool_()))

    order = Window.partitionBy("doc_id", "page_idx").orderBy(F.asc_nulls_last("reading_order"), F.desc("score"), "candidate_id")
    places = near.withColumn("_place", F.row_number().over(order)).select("_place", "reading_order", "block_id", "candidate_id", "score")
    return places.mapInArrow(pick, "block_id string, candidate_id string, score double")


def page_labels(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_idx, label): first printed page number in a page's furniture: digits, or Roman numerals, between dashes or not."""
    label = F.nullif(F.regexp_extract(F.trim("text"), "^[-—·\\s]*(\\d{1,4}|[ivxlcIVXLC]{1,7})[-—·\\s]*$", 1), F.lit(""))
    rows = blocks.withColumn("label", label).where("label IS NOT NULL")
    return rows.groupBy("doc_id", "page_idx").agg(F.min_by("label", "reading_order").alias("label"))


def recognition_scores(lines: DataFrame) -> DataFrame:
    """(page_idx, block, score) of recognised lines (page_idx, block, score): the least of a block's scores, null without any."""
    return lines.groupBy("page_idx", "block").agg(F.min("score").alias("score"))
