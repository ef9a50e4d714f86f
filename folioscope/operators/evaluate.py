"""Retrieval evaluation: hits, ranks, citations, failure buckets, comparison of runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import section_form


def path_fits(predicted: Column, gold: Column) -> Column:
    """A predicted section counts if it equals a gold one or contains it."""
    return F.contains(predicted, gold)


def filled(paths: Column) -> Column:
    return F.filter(F.coalesce(paths, F.array().cast("array<string>")), lambda p: F.trim(p) != "")


def hit_at(predicted: Column, gold: Column, k: int) -> Column:
    """1 if any of the first k predictions fits any gold path, else 0."""
    return F.exists(F.slice(filled(predicted), 1, k), lambda p: F.exists(filled(gold), lambda g: path_fits(p, g))).cast("double")


def reciprocal_rank(predicted: Column, gold: Column) -> Column:
    """One over the place of the first prediction that fits; 0 without one. Empty predictions keep their places."""
    places = F.transform(F.coalesce(predicted, F.array().cast("array<string>")), lambda p, i: F.when((F.trim(p) != "") & F.exists(filled(gold), lambda g: path_fits(p, g)), i + 1))
    first = F.array_min(F.array_compact(places))
    return F.coalesce(1.0 / first, F.lit(0.0))


def citation_hit(predicted: Column, gold: Column) -> Column:
    return F.coalesce(F.arrays_overlap(filled(predicted), filled(gold)), F.lit(False)).cast("double")


def failure_bucket(targets: Column, paths: Column, types: Column, gold: Column, hard: Column, gold_paths: Column, gold_types: Column) -> Column:
    """What went wrong, most telling first; `ok` if a gold target is cited."""
    return (
        F.when(citation_hit(targets, gold) > 0, "ok")
        .when(citation_hit(targets, hard) > 0, "hard_negative_bias")
        .when(hit_at(paths, gold_paths, 5) > 0, "wrong_section_bias")
        .when(F.array_contains(gold_types, "figure") & F.array_contains(types, "content"), "caption_body_confusion")
        .when(F.array_contains(gold_types, "formula") & F.array_contains(types, "formula_param"), "formula_symbol_confusion")
        .otherwise("missed_exact_target")
    )


def scores(predicted: DataFrame) -> DataFrame:
    """hit@1, hit@3, hit@5 and reciprocal rank of (question_id, paths, gold): questions without gold are left out."""
    rows = predicted.where(F.size(filled(F.col("gold"))) > 0)
    return rows.select("question_id", *(hit_at(F.col("paths"), F.col("gold"), k).alias(f"hit_{k}") for k in (1, 3, 5)), reciprocal_rank(F.col("paths"), F.col("gold")).alias("mrr"))


def compare_runs(before: DataFrame, after: DataFrame, *, key: str = "question_id", score: str = "score") -> DataFrame:
    """Questions of either run with what became of them: improved, regressed, same, added or removed."""
    pair = before.select(key, F.col(score).alias("before")).join(after.select(key, F.col(score).alias("after")), key, "full_outer")
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("after") > F.col("before"), "improved").when(F.col("after") < F.col("before"), "regressed").otherwise("same")
    return pair.withColumn("change", kind)


def quality(scores: Column, fallback: Column, threshold: float = 0.8) -> Column:
    """correct or wrong by the mean of the scores that there are, else by the fallback, else skipped."""
    there = F.array_compact(scores)
    mean = F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there))
    value = F.coalesce(mean, fallback)
    return F.when(value.isNull(), "skipped").when(value >= threshold, "correct").otherwise("wrong")


def mentions(answer: Column, words: Column, every: bool) -> Column:
    """Whether an answer contains all (or any) of the words, whatever the case."""
    has = lambda w: F.contains(F.lower(answer), F.lower(w))
    return F.forall(words, has) if every else F.exists(words, has)


def retrieval_rows(predicted: DataFrame) -> DataFrame:
    """One row per question (question_id, paths, gold): evaluated, score (hit@5), and the others; all null without gold."""
    some = F.size(filled(F.col("gold"))) > 0
    told = {**{f"hit_{k}": hit_at(F.col("paths"), F.col("gold"), k) for k in (1, 3, 5)}, "mrr": reciprocal_rank(F.col("paths"), F.col("gold"))}
    return predicted.select("question_id", some.alias("evaluated"), F.when(some, told["hit_5"]).alias("score"), *(F.when(some, v).alias(k) for k, v in told.items()))


def cites_sections(citations: Column, gold: Column) -> Column:
    """Whether any cited section equals, ends with or contains a gold one; any answer does where there is no gold."""
    norm = lambda paths: F.filter(F.transform(F.coalesce(paths, F.array().cast("array<string>")), section_form), lambda p: p != "")
    return F.when(F.size(norm(gold)) == 0, True).otherwise(F.exists(norm(citations), lambda c: F.exists(norm(gold), lambda g: F.contains(c, g))))


def sql_scores(runs: DataFrame) -> DataFrame:
    """Text-to-SQL questions (question_id, execution_status, generated_sql, expected_sql): score, execution_success and
    sql_exact_match, null without an expected statement."""
    success = F.coalesce(F.col("execution_status") == "success", F.lit(False))
    expected, generated = F.trim(F.coalesce("expected_sql", F.lit(""))), F.trim(F.coalesce("generated_sql", F.lit("")))
    return runs.select("question_id", success.cast("double").alias("score"), success.alias("execution_success"), F.when(expected != "", expected == generated).alias("sql_exact_match"))


def score_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, change) of two summaries (metric, value): what one lacks counts as 0."""
    pair = before.select("metric", F.col("value").alias("a")).join(after.select("metric", F.col("value").alias("b")), "metric", "full_outer")
    return pair.select("metric", F.round(F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0)), 4).alias("change"))


def case_summary(cases: DataFrame) -> DataFrame:
    """Test cases (status) in one row: total, passed, failed, skipped."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return cases.agg(F.count("*").alias("total"), of("passed"), of("failed"), of("skipped"))


def progress(runs: DataFrame, details: DataFrame) -> DataFrame:
    """Runs (run_id, total) with what is done of them so far (details: run_id, status, score): done, share, mean score; runs that
    nothing is done of have no mean."""
    done = ~F.col("status").isin("pending", "running")
    so_far = details.groupBy("run_id").agg(F.count_if(done).alias("done"), F.avg(F.when(done, F.col("score"))).alias("mean_score"))
    return runs.join(so_far, "run_id", "left").select("run_id", F.coalesce("done", F.lit(0)).alias("done"), F.when(F.col("total") > 0, F.coalesce("done", F.lit(0)) / F.col("total")).alias("share"), "mean_score")


#: Evaluators by name: each takes a table of predictions and gives one row per question.
EVALUATORS: dict[str, Callable[[DataFrame], DataFrame]] = {"retrieval": retrieval_rows, "text2sql": sql_scores}


def enriched(details: DataFrame, questions: DataFrame, *columns: str) -> DataFrame:
    """Details of runs with columns of their questions; a detail's own value wins."""
    own = [c for c in columns if c in details.columns]
    rows = details.join(questions.select("question_id", *(F.col(c).alias(f"_{c}") for c in columns)), "question_id", "left")
    return rows.select(*(F.coalesce(c, f"_{c}").alias(c) if c in own else F.col(c) for c in details.columns), *(F.col(f"_{c}").alias(c) for c in columns if c not in own))
