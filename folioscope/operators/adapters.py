"""The three searches that answer questions, behind one signature: knowledge, tables, entities.

Each takes a question and a number, and gives the same columns: mark, key, item_id, doc_id, kind, title, text, score. A key stands for one piece of
evidence, whatever items show it. Marks cite the items: K1, K2, ... for knowledge, T for tables, E for entities.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.query import Question
from folioscope.operators import retrieval
from folioscope.session import written

FOUND = ["mark", "key", "item_id", "doc_id", "kind", "title", "text", "score"]
#: Gives the candidates of the routes for a question: {route: candidates}.
Routes = Callable[[Question], Mapping[str, DataFrame]]
Search = Callable[..., DataFrame]


def _marked(items: DataFrame, prefix: str, *ties: Column) -> DataFrame:
    """The few items of an answer with their marks, best first."""
    return retrieval.numbered_marks(items, prefix, [F.desc("score"), *ties, F.col("item_id")]).select(*FOUND)


def _fused(candidates: Mapping[str, DataFrame], question: Question, top: int, tables: tuple[DataFrame, DataFrame] | None, prefix: str) -> DataFrame:
    """Candidates fused and re-ranked, in that order; none for an empty question."""
    found = retrieval.hybrid(candidates, question, top=top, tables=tables).withColumn("score", F.col("rerank_score"))
    return _marked(found if question.text.strip() else found.limit(0), prefix, F.desc("normal"), F.char_length("text"), F.col("key"))


@dataclass
class Searches:
    """Searches over one collection. tables: (tables, rows), for the full text of tables that are shown. entities: entity_id, name,
    aliases, doc_id. An empty question finds nothing."""

    routes: Routes
    entities: DataFrame
    tables: tuple[DataFrame, DataFrame] | None = None

    def knowledge_search(self, text: str, *, top: int = 20, task: str = "content_qa") -> DataFrame:
        """Passages by all routes that the question calls for."""
        question = Question(text, task=task)
        return _fused(self.routes(question), question, top, self.tables, "K")

    def table_search(self, text: str, *, top: int = 20, task: str = "table_qa") -> DataFrame:
        """Tables and formulas alone, always as a question about tables."""
        question = Question(text, task=task)
        given = {name: rows for name, rows in self.routes(question).items() if name in ("table", "formula")}
        # both take part, whatever words the question has
        few = {"table_and_formula": written(given["table"].unionByName(given["formula"]))}
        return _fused(few, question, top, self.tables, "T")

    def entity_search(self, text: str, *, top: int = 20, task: str = "content_qa") -> DataFrame:
        """Entities by name and alias; where there are none, what the knowledge search finds, marked alike."""
        found = written(retrieval.entity_search(self.entities, text, limit=top)) if text.strip() else self.entities.limit(0)
        if text.strip() and found.isEmpty():
            return self.knowledge_search(text, top=top, task=task).withColumn("mark", F.regexp_replace("mark", "^K", "E"))
        rows = found.select(F.col("entity_id").cast("string").alias("key"), F.col("entity_id").cast("string").alias("item_id"), F.col("doc_id").cast("long").alias("doc_id"), F.lit("entity").alias("kind"), F.col("name").alias("title"), F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), "\n").alias("text"), F.lit(1.0).alias("score"))
        return _marked(rows, "E")

    def tools(self) -> dict[str, Search]:
        """The searches by name: all are called as search(text, top=..., task=...)."""
        return {"knowledge_search": self.knowledge_search, "table_search": self.table_search, "entity_search": self.entity_search}
