"""Corpus pipeline: language, near duplicates, repeated passages, benchmark passages, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import is_held_out, materialize, read_table
from folioscope.llm.decontaminate import drop_contaminated
from folioscope.llm.jaccard_join import one_of_each
from folioscope.llm.language import UNDETERMINED, fit_language_model, predict_language
from folioscope.llm.mixing import mix
from folioscope.llm.suffix_dedup import without_repeats

#: Parameters of the language stage: a text of at least LEAST_CHARS characters is in no language if the best one holds less than
#: LEAST_SHARE of its n-grams. A shorter text has too few n-grams for a share to say anything: it stays, whatever its share, if it has letters.
LEAST_CHARS, LEAST_SHARE = 40, 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str, *, least_chars: int = LEAST_CHARS, least_share: float = LEAST_SHARE) -> DataFrame:
    """Keeps the documents that are in one of the languages that their labels teach.

    Null and empty texts and those without a letter are in none and go. Null languages teach nothing; rows of a null id
    are judged like others. Repeated rows stay repeated. An empty table stays empty; where no language is taught, all documents go.
    """
    model = fit_language_model(docs.where(~is_held_out(F.col("doc_id"))))
    told = docs.select(F.struct(*docs.columns).alias("row"), predict_language(docs, model).alias("told"))
    odd = (F.col("told.lang_pred") == UNDETERMINED) | (F.col("told.score") < least_share) & (F.char_length("row.text") >= least_chars)
    return told.where(~odd).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates.

    It stays with all rows that repeat it. Texts without words, null ones among them, are alike to nothing and stay, each of them. A
    null id comes after all others. An empty table stays empty.
    """
    return one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that occur earlier in the corpus from the texts; no document goes.

    A null text stays null, one that is cut whole becomes empty. Rows without an id come before all others. An empty table stays empty.
    """
    return without_repeats(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents without passages of the benchmark.

    Null and empty texts have none and stay, as do all texts where the benchmark is empty.
    """
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as its source's target asks for, the copies numbered from 1 in a last column.

    Null is a source of its own. Documents without words are copied like the others of their source, or not at all if it has no
    words. An empty table stays empty.
    """
    return mix(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("benchmark", benchmark), ("sources", sources)]

#: Neither language models nor similarity joins are SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
