"""Queries by name over the tables of a folder, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """Tables of a folder as attributes, and the shapes derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def blocks(self) -> DataFrame:
        """Lines of documents as blocks of 20 to a page: each page begins with a title, the rest by position."""
        lines = self.documents.where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
        kind = F.when(F.col("pos") % 20 == 0, "title").when(F.col("pos") % 7 == 3, "list_item").when(F.col("pos") % 11 == 5, "formula").otherwise("paragraph")
        return lines.select(
            "doc_id",
            F.concat_ws(":", "doc_id", "pos").alias("block_id"),
            F.col("pos").cast("long").alias("pos"),
            F.floor(F.col("pos") / 20).alias("page_idx"),
            (F.col("pos") % 20).cast("long").alias("reading_order"),
            kind.alias("block_type"),
            F.when(kind == "title", F.floor(F.col("pos") / 20) % 3 + 1).alias("title_level"),
            F.concat_ws(".", F.col("doc_id") % 9 + 1, F.floor(F.col("pos") / 20) + 1, F.col("pos") % 5 + 1).alias("clause_id"),
            "text",
        )

    @property
    def edges(self) -> DataFrame:
        """The hierarchy region - nation - customer, supplier as a graph: (source_id, target_id, relation_type, doc_id)."""
        parts = [
            self.nation.selectExpr("concat('nation-', n_nationkey) AS source_id", "concat('region-', n_regionkey) AS target_id", "'belongs_to' AS relation_type", "concat('doc-', n_regionkey) AS doc_id"),
            self.customer.selectExpr("concat('customer-', c_custkey) AS source_id", "concat('nation-', c_nationkey) AS target_id", "'located_in' AS relation_type", "concat('doc-', c_nationkey % 5) AS doc_id"),
            self.supplier.selectExpr("concat('supplier-', s_suppkey) AS source_id", "concat('nation-', s_nationkey) AS target_id", "'located_in' AS relation_type", "concat('doc-', s_nationkey % 5) AS doc_id"),
        ]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])


BLOCKS_SQL = """blocks AS (
    SELECT doc_id, doc_id || ':' || pos AS block_id, pos, pos // 20 AS page_idx, pos % 20 AS reading_order,
           CASE WHEN pos % 20 = 0 THEN 'title' WHEN pos % 7 = 3 THEN 'list_item' WHEN pos % 11 = 5 THEN 'formula' ELSE 'paragraph' END AS block_type,
           CASE WHEN pos % 20 = 0 THEN (pos // 20) % 3 + 1 END AS title_level, (doc_id % 9 + 1) || '.' || (pos // 20 + 1) || '.' || (pos % 5 + 1) AS clause_id, text
    FROM (SELECT doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL)))"""

EDGES_SQL = """edges AS (
    SELECT 'nation-' || n_nationkey AS source_id, 'region-' || n_regionkey AS target_id, 'belongs_to' AS relation_type, 'doc-' || n_regionkey AS doc_id FROM nation
    UNION ALL SELECT 'customer-' || c_custkey, 'nation-' || c_nationkey, 'located_in', 'doc-' || (c_nationkey % 5) FROM customer
    UNION ALL SELECT 'supplier-' || s_suppkey, 'nation-' || s_nationkey, 'located_in', 'doc-' || (s_nationkey % 5) FROM supplier)"""


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Registers a query under a name; `{blocks}` and `{edges}` in the SQL stand for the derived tables."""

    def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql:
            ORACLE_SQL[name] = sql.replace("{blocks}", BLOCKS_SQL).replace("{edges}", EDGES_SQL)
        return build

    return add
