"""Writes: whole documents replaced by partition, subsets exported, reports, Markdown."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replace_partitions(rows: DataFrame, path: str, *keys: str) -> None:
    """Overwrites just the partitions that the rows have, and leaves the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def export_subset(tables: Mapping[str, DataFrame], scope: DataFrame, key: str, path: str) -> None:
    """Writes the rows of each table whose key is in the scope to path/<table>."""
    for name, rows in tables.items():
        rows.join(scope.select(key).distinct(), key, "left_semi").write.mode("overwrite").parquet(f"{path}/{name}")


def export_documents(tables: Mapping[str, DataFrame], scope: DataFrame, key: str, path: str, *, relations: str, entities: str, bridges: Mapping[str, str] | None = None) -> None:
    """Writes the rows of documents in the scope, and of the entities that these rows name, to path/<table>.

    relations: the table with source_id and target_id; bridges: tables with an entity_id and the column that ties them to
    rows of another table of the same name, as {bridge: owner}. Entities are exported by name and not by document, each once.
    """
    wanted = scope.select(key).distinct()
    own = {name: rows.join(wanted, key, "left_semi") for name, rows in tables.items() if name != entities and name not in (bridges or {})}
    named = own[relations].select(F.explode(F.array("source_id", "target_id")).alias("entity_id"))
    for bridge, owner in (bridges or {}).items():
        tie = next(c for c in tables[bridge].columns if c != "entity_id")
        own[bridge] = tables[bridge].join(own[owner].select(tie), tie, "left_semi")
        named = named.unionByName(own[bridge].select("entity_id"))
    own[entities] = tables[entities].join(named, "entity_id", "left_semi")
    for name, rows in own.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def write_report(findings: DataFrame, path: str) -> None:
    """Appends findings as JSON lines, a folder per day."""
    findings.withColumn("day", F.current_date()).write.mode("append").partitionBy("day").json(path)


def markdown_block(kind: Column, text: Column, level: Column) -> Column:
    """A block in Markdown: titles with hashes, list items with dashes, formulas between dollars."""
    return (
        F.when(kind == "title", F.concat(F.repeat(F.lit("#"), F.coalesce(level, F.lit(1)).cast("int")), F.lit(" "), text))
        .when(kind == "list_item", F.concat(F.lit("- "), text))
        .when(kind == "formula", F.concat(F.lit("$$\n"), text, F.lit("\n$$")))
        .otherwise(text)
    )


def markdown(blocks: DataFrame) -> DataFrame:
    """(doc_id, body): blocks of each document in order, an empty line between them."""
    shown = F.struct("page_idx", "reading_order", markdown_block(F.col("block_type"), F.col("text"), F.col("title_level")).alias("md"))
    rows = blocks.groupBy("doc_id").agg(F.sort_array(F.collect_list(shown)).alias("blocks"))
    return rows.select("doc_id", F.array_join(F.transform("blocks", lambda b: b["md"]), "\n\n").alias("body"))
