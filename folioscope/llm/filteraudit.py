"""What each filter of a set removes, in every order in which the filters can be applied.

A document fails some subset of the filters. Applying a filter after others is an edge of the lattice of
subsets: (already-applied subset, next filter). Documents are counted per part and failed subset first, so a
count reaches each of the n * 2**(n-1) edges (80 for five filters) as one small row; an order of the filters is a path of n edges
through the lattice, and the aggregated edges are joined to the steps of all orders (600 for five filters).

Nulls: a null text is empty, a null source is the part '' (as is an empty one). Nothing is smaller than a null
doc_id and a null one is smaller than nothing, so its rows never fail the copy filter and make no other row fail it.
Repeated rows are documents of their own; rows of one doc_id aren't copies of each other. Several labels of one doc_id:
the document is good or toxic if one of them says so. An empty table has no parts, hence no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import materialize

BLANKS = "[\\x20\\x09-\\x0D]"
MARKS = "#$%&*|"
#: The name of the filter that rejects later copies; its condition needs the whole table.
COPY = "E"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions that one text decides: few words, repeated words, capitals, marks."""
    words = F.array_remove(F.split(text, BLANKS), "")
    n_words = F.size(words)
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": n_words < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n_words,
        "C": 100 * capitals > 2 * F.char_length(text),
        "D": reduce(or_, (text.contains(mark) for mark in MARKS)),
    }


def failed_subsets(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], text: Column) -> DataFrame:
    """(part, failed: bits of the filters in their order and of COPY last, n, good, toxic): documents counted, one row a part and subset.

    Texts are read once and leave the scan as a digest; equal texts fail the same text filters, so they meet as counts
    per part and label, never as a group of documents.
    """
    bits = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(filters.values())), F.lit(0))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), bits.alias("failed"))
    rows = rows.groupBy("doc_id", "part", "digest", "failed").agg(F.count(F.lit(1)).alias("n"))
    told = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = rows.join(told, "doc_id", "left").fillna(False, ["good", "toxic"])
    alike = rows.groupBy("digest", "part", "failed", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.coalesce(F.min_by("n", "doc_id"), F.lit(0)).alias("of_least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed")
    )
    alike = materialize(alike)  # read twice
    firsts = alike.groupBy("digest").agg(F.min("least").alias("first"))
    alike = alike.join(firsts, "digest")
    # rows without an id and those of the smallest id pass the copy filter, all others fail it
    passing = F.col("unnamed") + F.when(F.col("least") == F.col("first"), F.col("of_least")).otherwise(0)
    both = F.array(F.struct(F.lit(0).alias("copy"), passing.alias("n")), F.struct(F.lit(1).alias("copy"), (F.col("n") - passing).alias("n")))
    split = alike.select("part", "failed", "good", "toxic", F.inline(both)).where("n > 0")
    n = F.col("n")
    return split.groupBy("part", F.col("failed").bitwiseOR(F.col("copy") * F.lit(1 << len(filters))).alias("failed")).agg(
        F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic")
    )


def lattice_edges(subsets: DataFrame, names: list[str]) -> DataFrame:
    """(part, applied: bits, filter, counts, shapley) from (part, failed, n, good, toxic): one row a part and edge, zeros included.

    shapley weighs what an edge removes with the number of orders that go through it.
    """
    edges = [(applied, i) for applied in range(1 << len(names)) for i in range(len(names)) if not applied >> i & 1]
    factorial = [1]
    for k in range(1, len(names) + 1):
        factorial.append(factorial[-1] * k)
    fields = [F.struct(F.lit(s).alias("applied"), F.lit(i).alias("next"), F.lit(1 << i).alias("bit"), F.lit(factorial[s.bit_count()] * factorial[len(names) - 1 - s.bit_count()]).alias("orders")) for s, i in edges]
    rows = subsets.select("*", F.inline(F.array(*fields)))
    bit = F.col("bit")
    fails, before = F.col("failed").bitwiseAND(bit) > 0, F.col("failed").bitwiseAND(F.col("applied")) > 0
    here = fails & ~before

    def total(when: Column, what: str) -> Column:
        return F.sum(F.when(when, F.col(what)).otherwise(0))

    counted = rows.groupBy("part", "applied", "next").agg(
        total(~fails & ~before, "n").alias("kept"),
        total(here, "n").alias("removed"),
        total(fails & before, "n").alias("redundant"),
        total(F.col("failed") == bit, "n").alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
        F.first("orders").alias("orders"),
    )
    shares = counted.groupBy("part", "next").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    return counted.join(shares, ["part", "next"]).select("part", "applied", F.element_at(F.array(*map(F.lit, names)), F.col("next") + 1).alias("filter"), *COUNTS, "shapley")


def order_steps(names: list[str]) -> list[tuple[str, int, int, str]]:
    """(order, step, bits applied before, filter) for each step of each order."""
    bit = {name: 1 << i for i, name in enumerate(names)}
    return [("".join(p), k + 1, sum(bit[f] for f in p[:k]), f) for p in permutations(names) for k, f in enumerate(p)]


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters A to E and step: filter_order, step, COUNTS and shapley."""
    text = F.coalesce("text", F.lit(""))
    filters = text_filters(text)
    names = [*filters, COPY]
    edges = lattice_edges(failed_subsets(docs, labels, filters, text), names)
    # n! * n rows, whatever the data: 600 here
    steps = docs.sparkSession.createDataFrame(order_steps(names), "filter_order string, step int, applied int, filter string")
    return edges.join(F.broadcast(steps), ["applied", "filter"]).select("part", "filter_order", "step", *COUNTS, "shapley")
