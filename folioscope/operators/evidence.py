"""Evidence for answers and graphs: sections of Markdown, items in sections, packets, formulas with their explanations, seeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.terms import entity_layer, formula_form, formula_number, parameter, without_tag

HEADING = r"^#{1,6}\s+(.+)$"
#: Relation of a seed to what occurs with it, by the seed's layer.
RELATIONS = {"condition": "conditions_on", "action": "computes_from"}


def markdown_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, heading, body, start, stop): sections of Markdown texts by their headings, in order from 0.

    What comes before the first heading is a section without one, if it has any line. start and stop are
    places in the text, from 0, of the section's heading and its end.
    """
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    order = Window.partitionBy(key).orderBy("n")
    title = F.nullif(F.regexp_extract("line", HEADING, 1), F.lit(""))
    rows = lines.withColumn("title", F.trim(title)).withColumn("at", F.sum(F.char_length("line") + 1).over(order) - F.char_length("line") - 1)
    rows = rows.withColumn("group", F.sum(F.col("title").isNotNull().cast("int")).over(order))
    own = F.sort_array(F.collect_list(F.when(F.col("title").isNull(), F.struct("n", "line"))))
    out = rows.groupBy(key, "group").agg(
        F.coalesce(F.max("title"), F.lit("")).alias("heading"), F.array_join(F.transform(own, lambda x: x["line"]), "\n").alias("body"), F.min("at").alias("start"), F.max(F.col("at") + F.char_length("line")).alias("stop")
    )
    number = F.row_number().over(Window.partitionBy(key).orderBy("group")) - 1
    return out.select(key, number.cast("long").alias("section"), "heading", F.trim(F.btrim("body", F.lit("\n\t\r "))).alias("body"), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


def in_sections(items: DataFrame, sections: DataFrame, key: str) -> DataFrame:
    """Items (key, item, type, content, section_path) with the section that they belong to.

    By their section path where it is a heading; else by the heading item before them, if the document has
    any; else by the first section that holds their content; else the first section with a body.
    """
    first = sections.groupBy(key, "heading").agg(F.min("section").alias("by_path"))
    fallback = sections.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("body") != "", F.col("section"))), F.lit(0)).alias("fallback"))
    path = F.trim(F.coalesce("section_path", F.lit("")))
    rows = items.withColumn("heading", path).join(first.where("heading <> ''"), [key, "heading"], "left").drop("heading")
    rest = F.col("by_path").isNull()
    before = Window.partitionBy(key).orderBy("item").rowsBetween(Window.unboundedPreceding, 0)
    title = F.when(rest & (F.col("type") == "heading"), F.trim(F.coalesce("content", F.lit(""))))
    rows = rows.withColumn("under", F.last(title, True).over(before)).withColumn("headed", F.max(title.isNotNull()).over(Window.partitionBy(key)))
    rows = rows.join(first.select(key, F.col("heading").alias("under"), F.col("by_path").alias("by_heading")), [key, "under"], "left")
    asked = rows.where(rest & ~F.col("headed") & (F.coalesce("content", F.lit("")) != "")).select(key, "item", "content")
    held = asked.join(sections.select(key, "section", "body", "heading"), key).where(F.contains("body", F.col("content")) | F.contains("heading", F.col("content")))
    rows = rows.join(held.groupBy(key, "item").agg(F.min("section").alias("by_text")), [key, "item"], "left").join(fallback, key, "left")
    section = F.when(~rest, F.col("by_path")).when(F.col("headed"), F.when(F.col("under").isNull(), F.lit(0)).otherwise(F.coalesce("by_heading", "fallback"))).otherwise(F.coalesce("by_text", "fallback"))
    return rows.select(*(c for c in items.columns), section.cast("long").alias("section"))


def packet_fields(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per packet the ids, tables, formulas, entities and conditions of its items (item, id, type, content, formula, entities, conditions), in order, each once."""

    def gathered(value: Column) -> Column:
        rows = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct("item", value.alias("x")))))
        return F.array_distinct(F.transform(rows, lambda r: r["x"]))

    def flat(column: str) -> Column:
        rows = F.sort_array(F.collect_list(F.when(F.col(column).isNotNull(), F.struct("item", F.col(column).alias("x")))))
        return F.array_distinct(F.flatten(F.transform(rows, lambda r: r["x"])))

    content = F.coalesce("content", F.lit(""))
    formula = F.coalesce(F.nullif("formula", F.lit("")), F.when(F.col("type") == "formula", F.nullif(content, F.lit(""))))
    return items.groupBy(*keys).agg(
        gathered(F.nullif("id", F.lit(""))).alias("block_ids"), gathered(F.when(F.col("type") == "table", content)).alias("tables"), gathered(formula).alias("formulas"), flat("entities").alias("entities"), flat("conditions").alias("conditions")
    )


# ---------------------------------------------------------------- formulas


def explanations(blocks: DataFrame, *, most: int = 8, reach: int = 200) -> DataFrame:
    """Formulas with the lines that explain them: the first paragraphs and list items after them, of their section or none, a
    page away at most. Looks at `reach` blocks of the document, so that no formula gathers the rest of a long one."""
    order = Window.partitionBy("doc_id").orderBy("page_idx", "reading_order").rowsBetween(1, reach)
    text = formula_form(F.col("text"))
    part = F.when(F.col("block_type").isin("paragraph", "list_item") & (text != ""), F.struct(F.coalesce("section_path", F.lit("")).alias("section"), F.col("page_idx").alias("page"), text.alias("text")))
    rows = blocks.withColumn("_after", F.collect_list(part).over(order)).where("block_type = 'formula'")
    close = F.filter("_after", lambda b: ((b["section"] == F.coalesce("section_path", F.lit(""))) | (b["section"] == "")) & (F.abs(b["page"] - F.col("page_idx")) <= 1))
    return rows.withColumn("lines", F.slice(F.transform(close, lambda b: b["text"]), 1, most)).drop("_after")


def formula_facts(formulas: DataFrame) -> DataFrame:
    """Formulas (text, lines) with what they say: number, body without its tag, parameters from the lines, and a summary."""
    cuts = F.flatten(F.transform("lines", lambda x: F.split(formula_form(x), r"[；;]\s*(?=(?:式中|其中|注[:：]?)?\s*[A-Za-zΑ-Ωα-ω\\])")))
    rows = formulas.withColumn("formula_text", formula_form(F.col("text"))).withColumn("explanation_lines", F.array_distinct(F.filter(F.transform(cuts, formula_form), lambda x: x != "")))
    rows = rows.withColumn("formula_number", formula_number(F.col("formula_text"), F.col("explanation_lines"))).withColumn("formula_params", F.array_compact(F.transform("explanation_lines", parameter)))
    symbols = F.array_join(F.transform(F.slice("formula_params", 1, 8), lambda p: p["symbol"]), ", ")
    named = F.coalesce(F.nullif("formula_text", F.lit("")), F.lit("未命名公式"))
    summary = F.concat(F.when(F.col("formula_number").isNotNull(), F.concat(F.lit("公式("), "formula_number", F.lit(") "))).otherwise(""), named, F.when(F.size("formula_params") > 0, F.concat(F.lit("；包含 "), F.size("formula_params"), F.lit(" 个参数："), symbols)).otherwise(""))
    return rows.withColumn("formula_body", without_tag(F.col("text"))).withColumn("formula_param_count", F.size("formula_params")).withColumn("formula_summary", summary)


# ---------------------------------------------------------------- seeds


def seed_occurrences(packets: DataFrame, seeds: DataFrame) -> DataFrame:
    """(packet_id, seed, place): where a seed (name, layer, aliases) first occurs in a packet (packet_id, text), by its name or else its first alias that does.

    The seed list is small and goes to every task as one array; packets stay where they are.
    """
    listed = seeds.agg(F.sort_array(F.collect_list(F.struct("name", "layer", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases")))).alias("seeds"))
    rows = packets.join(F.broadcast(listed))  # one row

    def place(seed: Column) -> Column:
        forms = F.concat(F.array(seed["name"]), seed["aliases"])
        found = F.filter(F.transform(forms, lambda f: F.position(f, F.col("text"))), lambda p: p > 0)
        return F.get(found, F.lit(0)) - 1

    spots = F.filter(F.transform("seeds", lambda s: F.struct(s["name"].alias("seed"), s["layer"].alias("layer"), place(s).alias("place"))), lambda s: s["place"].isNotNull())
    return rows.select("packet_id", F.explode(spots).alias("s")).select("packet_id", "s.seed", "s.layer", F.col("s.place").cast("long").alias("place"))


def expanded(packets: DataFrame, seeds: DataFrame, *, ignored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities and relations that packets (packet_id, text, doc_id, section_path) give: every two seeds of a packet.

    Entities: (name, layer, packet_id) of what occurs beside a seed; relations: (source, target, relation_type,
    doc_id, section_path), typed by the seed's layer. Names that are ignored (name), or were deleted, stay out. Pairs
    are those of the short seed list within one packet.
    """
    spots = seed_occurrences(packets, seeds)
    if ignored is not None:
        others = spots.join(ignored.select(F.col("name").alias("seed")).distinct(), "seed", "left_anti")
    else:
        others = spots
    pairs = spots.select("packet_id", F.col("seed").alias("source"), "layer").join(others.select("packet_id", F.col("seed").alias("target")), "packet_id").where("source <> target")
    kinds = F.create_map(*(F.lit(x) for pair in RELATIONS.items() for x in pair))
    relations = pairs.join(packets.select("packet_id", "doc_id", "section_path"), "packet_id").select("source", "target", F.coalesce(F.try_element_at(kinds, F.col("layer")), F.lit("constrains")).alias("relation_type"), "doc_id", "section_path")
    entities = pairs.select(F.col("target").alias("name"), entity_layer(F.col("target")).alias("layer"), "packet_id").distinct()
    return entities, relations
