"""Listings and filters over blocks, chunks, tables and records: pushed to the scan where they can be."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import contains_clause, let, related_clause


def keyword_hit(keyword: str, *columns: str) -> Column:
    """Whether any of the columns contains a keyword, whatever the case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(keyword.lower())), F.lit(False))
    return hit


def listing(rows: DataFrame, *, where: Column | None = None, kinds: Sequence[str] | None = None, kind: str = "block_type", keyword: str | None = None, columns: Sequence[str] = ("text",), order: Sequence[str | Column], limit: int, most: int = 1000) -> DataFrame:
    """Rows that fit a condition, a set of kinds and a keyword, in order, 1 to `most` of them."""
    if where is not None:
        rows = rows.where(where)
    if kinds:
        rows = rows.where(F.col(kind).isin(*kinds))
    if keyword:
        rows = rows.where(keyword_hit(keyword, *columns))
    return rows.orderBy(*order).limit(max(1, min(most, limit)))


def page(rows: DataFrame, *, order: Sequence[str | Column], offset: int, limit: int) -> DataFrame:
    """One page of a listing."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(1, limit))


def by_clause(rows: DataFrame, refs: Sequence[str], *, clause: str = "clause_id", then: Sequence[str] = (), limit: int = 50) -> DataFrame:
    """Rows whose clause number equals one of the references, or is above or below it."""
    hit = F.lit(False)
    for ref in refs:
        hit = hit | related_clause(F.col(clause), F.lit(ref))
    return rows.where(F.coalesce(hit, F.lit(False))).orderBy(clause, *then).limit(max(1, min(50, limit)))


def metadata_filter(rows: DataFrame, *, section: str | None = None, first_page: int | None = None, last_page: int | None = None, tags: Sequence[str] = (), tag_columns: Sequence[str] = ()) -> DataFrame:
    """Rows in a section, a page range, and with any of the tags in any of the tag columns. A null page is page 0."""
    number = F.coalesce(F.col("page_idx"), F.lit(0))
    if section:
        rows = rows.where(F.contains(F.coalesce(F.col("section_path"), F.lit("")), F.lit(section)))
    if first_page is not None:
        rows = rows.where(number >= first_page)
    if last_page is not None:
        rows = rows.where(number <= last_page)
    wanted = sorted({t.strip() for t in tags} - {""})
    if wanted:
        own = F.array_union(F.array().cast("array<string>"), F.flatten(F.array(*(F.coalesce(F.col(c), F.array().cast("array<string>")) for c in tag_columns))))
        rows = rows.where(F.arrays_overlap(F.transform(own, lambda x: F.trim(x)), F.array(*map(F.lit, wanted))))
    return rows


def contents_page(title: Column, section: Column, text: Column, kind: Column, number: Column) -> Column:
    """Whether a candidate comes from a table of contents."""
    scope = F.concat_ws("\n", F.coalesce(section, F.lit("")), F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")))
    return F.contains(scope, F.lit("目次")) | F.contains(scope, F.lit("目录")) | (F.coalesce(number, F.lit(0)) == 0) & F.coalesce(kind, F.lit("")).isin("outline_anchor", "list_procedure")


def any_token(rows: DataFrame, tokens: Sequence[str], *columns: str) -> DataFrame:
    """Rows in which any of the tokens occurs in any of the columns."""
    forms = F.array(*(F.lower(F.col(c)) for c in columns))  # made once for all tokens
    return rows.where(let(forms, lambda own: F.exists(own, lambda c: F.coalesce(reduce(or_, (F.contains(c, F.lit(t.lower())) for t in tokens), F.lit(False)), F.lit(False)))))


def with_exact_clause(rows: DataFrame, ref: str, column: str = "text") -> DataFrame:
    return rows.where(contains_clause(F.col(column), ref))


def nested(parents: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """Parents with the rows of each child table as a sorted array of structs: a whole aggregate in one row.

    Children are grouped before they are joined, so a parent's children meet once; parents without any get empty arrays.
    """
    out = parents
    for name, child in children.items():
        rest = [c for c in child.columns if c != key]
        kind = child.select(F.array(F.struct(*rest)).alias("x")).schema["x"].dataType
        grouped = child.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name))
        out = out.join(grouped, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out


def pages(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_idx, n_blocks, n_chars) of the pages that have blocks."""
    return blocks.groupBy("doc_id", "page_idx").agg(F.count("*").alias("n_blocks"), F.sum(F.char_length("text")).alias("n_chars"))


def page_numbers(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_idx): all pages from 0 to the last that has a block, also those without any."""
    return blocks.groupBy("doc_id").agg(F.max("page_idx").cast("long").alias("last")).where("last >= 0").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("page_idx"))


def page_counts(blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, pages) of the asked documents (doc_id)."""
    return blocks.join(docs.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg((F.max("page_idx") + 1).alias("pages"))


def with_labels(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """Blocks with the printed label (doc_id, page_idx, label) of their page, empty where it has none; of several labels the smallest."""
    one = labels.groupBy("doc_id", "page_idx").agg(F.min("label").alias("label"))
    return blocks.join(one, ["doc_id", "page_idx"], "left").withColumn("label", F.coalesce("label", F.lit("")))


def nodes_and_folders(docs: DataFrame, *, prefix: str = "d") -> DataFrame:
    """(id, parent_id, kind): documents (doc_id, folder) as nodes, and their folders, each once."""
    nodes = docs.select(F.concat(F.lit(prefix), "doc_id").alias("id"), F.col("folder").alias("parent_id"), F.lit("document").alias("kind"))
    folders = docs.select(F.col("folder").alias("id"), F.lit("folder").alias("kind")).distinct()
    return nodes.unionByName(folders, allowMissingColumns=True)


def reference_search(rows: DataFrame, key: str, title: str, others: Mapping[str, float], query: str, *, limit: int = 20) -> DataFrame:
    """(key, score): what a mention may refer to. A title that is the query gets 24 points, begins with it 18, holds it 14; each other
    column that holds it gets its own points. Best first, then by key."""
    asked = F.lit(query.lower())
    name = F.lower(title)
    has = lambda c: F.coalesce(F.contains(c, asked), F.lit(False))
    score = F.when(name == asked, 24.0).when(F.startswith(name, asked), 18.0).when(has(name), 14.0).otherwise(0.0)
    for column, points in others.items():
        score = score + F.when(has(F.lower(column)), points).otherwise(0.0)
    return rows.select(key, score.alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(limit)


def vector_records(rows: DataFrame, prefix: str, kind: str, key: str, content: Column) -> DataFrame:
    """(record_id, entity_type, content): what an item's vector is made of, under an id that tells kinds apart."""
    return rows.select(F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string")).alias("record_id"), F.lit(kind).alias("entity_type"), content.alias("content"))
