"""Aggregations: counts by kind, scoped counts, table features, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts_by(rows: DataFrame, *dimensions: str) -> DataFrame:
    """Rows by each dimension on its own and in total, in one pass: (dimension, value, n)."""
    sets = [F.struct(F.lit("total").alias("dimension"), F.lit(None).cast("string").alias("value"))]
    sets += [F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]
    return rows.select(F.explode(F.array(*sets)).alias("d")).groupBy("d.dimension", "d.value").agg(F.count("*").alias("n"))


def rolled_up(rows: DataFrame, *dimensions: str) -> DataFrame:
    """Counts at each level of a hierarchy of dimensions, with the grand total."""
    return rows.rollup(*dimensions).agg(F.count("*").alias("n"))


def scoped_count(rows: DataFrame, scope: DataFrame, key: str) -> DataFrame:
    """Number of rows whose key is in a scope."""
    return rows.join(scope.select(key), key, "left_semi").agg(F.count("*").alias("n"))


def dimension_stats(vectors: DataFrame, kind: str, vector: str) -> DataFrame:
    """Vectors by kind: their number and smallest and largest dimension."""
    return vectors.groupBy(kind).agg(F.count("*").alias("n"), F.min(F.size(vector)).cast("long").alias("min_dim"), F.max(F.size(vector)).cast("long").alias("max_dim"))


def period_stats(records: DataFrame, at: Column, who: str, amount: str) -> DataFrame:
    """Number and sum by day and person."""
    return records.groupBy(F.to_date(at).alias("day"), who).agg(F.count("*").alias("n"), F.sum(amount).alias("total"))


#: Units that table cells are searched for, and characters that a number may have.
UNITS = ("%", "MPa", "kN", "m", "mm", "kg", "m3", "km", "kPa")
NUMERIC = "^[0-9.+\\-%/,:() ]+$"
LONG_CELL = 20


def table_features(rows: Column) -> Column:
    """Struct of numeric_ratio, avg_cell_length, long_text_cell_ratio, first_col_uniqueness, unit_density of an array of rows."""
    trimmed = F.transform(rows, lambda r: F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("")))))
    cells = F.filter(F.flatten(trimmed), lambda c: c != "")
    n = F.greatest(F.size(cells), F.lit(1))
    count = lambda test: F.size(F.filter(cells, test))
    first = F.filter(F.transform(F.filter(trimmed, lambda r: F.size(r) > 0), lambda r: F.get(r, F.lit(0))), lambda c: c != "")
    unit = "|".join(u.replace("%", "\\%") for u in UNITS)
    return F.struct(
        (count(lambda c: c.rlike(NUMERIC)) / n).alias("numeric_ratio"),
        (F.aggregate(cells, F.lit(0), lambda a, c: a + F.char_length(c)) / n).alias("avg_cell_length"),
        (count(lambda c: F.char_length(c) >= LONG_CELL) / n).alias("long_text_cell_ratio"),
        (F.size(F.array_distinct(first)) / F.greatest(F.size(first), F.lit(1))).alias("first_col_uniqueness"),
        (count(lambda c: c.rlike(unit)) / n).alias("unit_density"),
    )


def table_kind(features: Column) -> Column:
    """text_dense, numeric_dense, mapping_enum or hybrid."""
    numeric, long_, unique = features["numeric_ratio"], features["long_text_cell_ratio"], features["first_col_uniqueness"]
    return (
        F.when((long_ >= 0.30) & (numeric < 0.40), "text_dense")
        .when((numeric >= 0.60) & (long_ <= 0.10), "numeric_dense")
        .when((unique >= 0.80) & long_.between(0.05, 0.40) & (numeric <= 0.50), "mapping_enum")
        .otherwise("hybrid")
    )


def grouped_scores(runs: DataFrame, dimensions: Sequence[str], score: str) -> DataFrame:
    """Number and mean score by each value of each dimension; array dimensions count once per element."""

    def pairs_of(dimension: str) -> Column:
        kind = dict(runs.dtypes)[dimension]
        values = F.col(dimension) if kind.startswith("array") else F.array(F.col(dimension).cast("string"))
        return F.transform(values, lambda v: F.struct(F.lit(dimension).alias("dimension"), v.cast("string").alias("value")))

    pairs = [pairs_of(d) for d in dimensions]
    return runs.select(F.explode(F.flatten(F.array(*pairs))).alias("d"), score).groupBy("d.dimension", "d.value").agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"))


def clusters(rows: DataFrame, signature: str, key: str, size: str, *, shown: int) -> DataFrame:
    """(signature, n, first): clusters with their number of members and the keys of the largest few, in order of keys.

    Spark keeps the best of each task before it ranks a cluster, so no cluster is collected.
    """
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(signature).orderBy(F.desc(size), key))).where(F.col("_rank") <= shown)
    first = ranked.groupBy(signature).agg(F.sort_array(F.collect_list(key)).alias("first"))
    return rows.groupBy(signature).agg(F.count("*").alias("n")).join(first, signature)


def hashed_cluster(signature: Column, n: int) -> Column:
    """Number of a cluster, from 0, by a hash of its signature."""
    return F.pmod(F.conv(F.substring(F.md5(signature), 1, 8), 16, 10).cast("long"), F.lit(n))


def outdated(rows: DataFrame, family: str, year: str) -> DataFrame:
    """Rows of an earlier year than the newest of their family."""
    newest = rows.groupBy(family).agg(F.max(year).alias("_newest"))
    return rows.join(newest, family).where(F.col(year) < F.col("_newest")).drop("_newest")


def level_consistency(titles: DataFrame) -> DataFrame:
    """(rate, n): share of titles (doc_id, pos, title_level) that are at most one level below the one before them in their document."""
    before = F.lag("title_level").over(Window.partitionBy("doc_id").orderBy("pos"))
    fits = titles.select((before.isNull() | (F.col("title_level") <= before + 1)).cast("double").alias("fits"))
    return fits.agg(F.avg("fits").alias("rate"), F.count("*").alias("n"))
