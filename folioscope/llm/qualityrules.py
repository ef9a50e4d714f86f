"""Quality rules whose cutoffs reject good texts with a bounded risk.

Fixed base rules come first. Texts that pass them are judged by five rules: a statistic above its cutoff rejects the text. The
cutoffs of a stratum (a language) move together along a path from lenient to strict. Good texts of the proposal fold give the
path: first their largest value plus a margin that shrinks, then values that a growing share of them exceeds. On
the holdout, which the path has not seen, a step of the path is certified if the exact binomial test rejects "more than
RISK of the good texts are lost". Steps are tested in their order up to the first that fails, and each stratum gets an equal part of ERROR
(fixed-sequence testing within, Bonferroni over the strata): with probability 1 - ERROR no stratum loses more than RISK of its good
texts to the rules. Of the certified steps the one that rejects most bad texts of the proposal fold is taken, the most lenient of equal ones.
A stratum without a certified step has no cutoffs: only its base rules reject.

Counts over all labelled texts decide, there is no sample. Documents leave the scan as a row of counts, everything after works on these.

The guarantee takes labelled texts for independent draws of their stratum.

Nulls: a null text has no words, a null language is the stratum ''. Labels of a null doc_id or quality are left out; several labels
of one id make it good if one says so; repeated rows of a document count as often as they occur. Empty tables give no rows and no cutoffs.
"""

from __future__ import annotations

from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import materialize, mix, slabs, small_batches, span_hashes, text_bytes

#: Share of a stratum's good texts that the rules may lose, and the probability that some stratum loses more.
RISK, ERROR = 0.02, 0.05
#: The base rules: texts of fewer words, or with a larger share of repeated words (per cent), fail.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Labelled texts by crc32 of the id modulo 4: those of fold 0 propose cutoffs, the others certify them.
FOLDS, PROPOSES = 4, 0
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rules: whole numbers of which large ones are suspect, up to LARGEST; per cent for lengths of words, per mille of words for the others.
RULES = ("long_words", "short_words", "symbols", "dup_lines", "repeat_words")
LARGEST = 100_000
#: The path: margins above the largest value of good texts, then shares (per mille) of good texts above the cutoff.
MARGINS, SHARES = (400, 200, 100, 50), (0, 1, 2, 3, 4, 5, 7, 10, 15, 20)


# ---------------------------------------------------------------- counts of a text

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def _spans(inside: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values; runs don't cross cuts."""
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    cuts = cuts[(cuts > 0) & (cuts < len(inside))]
    opens[cuts] = inside[cuts]
    closes[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def _later_copies(row: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Size of each item's group of equal (row, hash), and whether the item is the first of it; items are in order."""
    order = np.lexsort((np.arange(len(row)), hashes, row))
    new = np.ones(len(row), bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    group = np.cumsum(new) - 1
    size, first = np.zeros(len(row), np.int64), np.zeros(len(row), bool)
    size[order] = np.bincount(group)[group] if len(row) else 0
    first[order] = new
    return size, first


def text_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """COUNTS of each row of UTF-8 bytes: rows x COUNTS. Words, lines and windows of three words are told by 64-bit hashes."""
    offsets = offsets - offsets[0]
    n = len(offsets) - 1
    cuts = offsets[1:-1]
    inside = ~BLANK[data]
    starts, ends = _spans(inside, cuts)
    first = np.searchsorted(starts, offsets)
    out = np.zeros((n, len(COUNTS)), np.int64)
    out[:, 0] = np.diff(first)

    def per_row(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags)))
        return sums[offsets[1:]] - sums[offsets[:-1]]

    out[:, 1] = per_row(inside & ((data & 0xC0) != 0x80))
    out[:, 2] = per_row(SYMBOL[data])

    line_starts, line_ends = _spans(data != 0x0A, cuts)
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[worded], line_ends[worded]
    line_row = np.searchsorted(offsets, line_starts, "right") - 1
    _, is_first = _later_copies(line_row, span_hashes(data, line_starts, line_ends))
    out[:, 3] = np.bincount(line_row[~is_first], minlength=n)

    row = np.repeat(np.arange(n), np.diff(first))
    whole = np.flatnonzero(row[2:] == row[:-2])  # first words of windows
    hashes = span_hashes(data, starts, ends)
    windows = mix(mix(mix(hashes[whole]) + hashes[whole + 1]) + hashes[whole + 2])
    size, _ = _later_copies(row[whole], windows)
    twice = whole[size > 1]
    covered = np.zeros(len(row), bool)
    for k in range(3):
        covered[twice + k] = True
    out[:, 4] = np.bincount(row[covered], minlength=n)
    return out


def counts_column(text: Column) -> Column:
    """Struct of COUNTS of a whole text; a null text has none of anything."""

    def count(texts: pa.Array) -> pa.Array:
        data, offsets = text_bytes(texts)
        parts = [text_counts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1]) for lo, hi in slabs(offsets)]
        table = np.concatenate(parts) if parts else np.zeros((0, len(COUNTS)), np.int64)
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(table[:, i])) for i in range(len(COUNTS))], list(COUNTS))

    return F.arrow_udf(count, "struct<" + ", ".join(f"{c}: bigint" for c in COUNTS) + ">")(text)


def base_failed(counts: Column) -> Column:
    return (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])


def rule_values(counts: Column) -> list[Column]:
    """Values of RULES; zero where there are no words."""
    words = F.greatest(counts["n_words"], F.lit(1))
    length = F.least(F.floor(100 * counts["word_chars"] / words), F.lit(LARGEST)).cast("long")
    return [length, -length, *(F.least(F.floor(1000 * counts[c] / words), F.lit(LARGEST)).cast("long") for c in ("n_symbols", "n_dup_lines", "n_repeat_words"))]


# ---------------------------------------------------------------- exact binomial test


def _fraction(a: np.ndarray, b: np.ndarray, x: float) -> np.ndarray:
    """Continued fraction of the incomplete beta function, until it no longer changes (Lentz's scheme)."""
    tiny = 1e-300
    c, d = np.ones_like(a), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 200_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h *= step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    return h


def _beta(a: np.ndarray, b: np.ndarray, x: float) -> np.ndarray:
    """Regularised incomplete beta function; a, b > 0."""
    front = np.exp([lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(x) + q * np.log1p(-x) for p, q in zip(a, b, strict=True)])
    low = x < (a + 1) / (a + b + 2)
    out = np.empty(len(a))
    out[low] = (front * _fraction(a, b, x) / a)[low] if low.any() else 0
    out[~low] = 1 - (front * _fraction(b, a, 1 - x) / b)[~low] if (~low).any() else 0
    return out


def binomial_tail(lost: np.ndarray, n: np.ndarray, risk: float) -> np.ndarray:
    """Probability of at most so many losses among n texts that are lost with probability `risk` each; 1 without texts."""
    lost, n = np.asarray(lost, float), np.asarray(n, float)
    out = np.ones(len(n))
    some = (n > 0) & (lost < n)
    if some.any():
        out[some] = _beta(n[some] - lost[some], lost[some] + 1, 1 - risk)
    return out


# ---------------------------------------------------------------- cutoffs


def path_cutoffs(good: DataFrame) -> DataFrame:
    """(stratum, step, cutoffs: array by rule) from (stratum, values) of the proposal fold's good texts.

    Values are counted per stratum, rule and value first; values are whole numbers up to LARGEST, so a window holds a bounded number of rows.
    """
    counted = good.select("stratum", F.posexplode("values").alias("rule", "value")).groupBy("stratum", "rule", "value").count()
    above = Window.partitionBy("stratum", "rule").orderBy(F.col("value").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("stratum", "rule")
    ranked = counted.select("stratum", "rule", "value", F.coalesce(F.sum("count").over(above), F.lit(0)).alias("above"), F.sum("count").over(whole).alias("n"))
    # the smallest value that at most a share of the texts exceeds
    cuts = [F.max("value") + m for m in MARGINS] + [F.min(F.when(1000 * F.col("above") <= s * F.col("n"), F.col("value"))) for s in SHARES]
    by_rule = ranked.groupBy("stratum", "rule").agg(F.array(*cuts).alias("cuts")).select("stratum", "rule", F.posexplode("cuts").alias("step", "cutoff"))
    return by_rule.groupBy("stratum", "step").agg(F.transform(F.array_sort(F.collect_list(F.struct("rule", "cutoff"))), lambda x: x["cutoff"]).alias("cutoffs"))  # len(RULES) entries


def exceeds(values: Column, cutoffs: Column) -> Column:
    """Whether some value lies above its cutoff."""
    return F.exists(F.arrays_zip(values.alias("v"), cutoffs.alias("c")), lambda x: x["v"] > x["c"])


def certified_cutoffs(labelled: DataFrame, *, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, step, cutoffs, n, lost, p_value): the chosen step of each stratum that has a certified one.

    labelled: (stratum, values: array by rule, good boolean, proposes boolean), without texts that the base rules reject.
    """
    path = materialize(path_cutoffs(labelled.where("proposes AND good").select("stratum", "values")))
    whole_path = path.groupBy("stratum").agg(F.array_sort(F.collect_list(F.struct("step", "cutoffs"))).alias("path"))  # one entry a step
    met = labelled.join(whole_path, "stratum")
    rejected = F.transform("path", lambda s: exceeds(F.col("values"), s["cutoffs"]))
    counted = met.groupBy("stratum", "good", "proposes", rejected.alias("rejected")).count()
    steps = counted.select("stratum", "good", "proposes", "count", F.posexplode("rejected").alias("step", "rejected"))

    def number(when: Column) -> Column:
        return F.sum(F.when(when, F.col("count")).otherwise(0))

    def tail(lost: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array(binomial_tail(lost.to_numpy(zero_copy_only=False), n.to_numpy(zero_copy_only=False), risk))

    holdout = F.col("good") & ~F.col("proposes")
    caught = ~F.col("good") & F.col("proposes") & F.col("rejected")
    sums = steps.groupBy("stratum", "step").agg(number(holdout).alias("n"), number(holdout & F.col("rejected")).alias("lost"), number(caught).alias("caught"))
    tested = materialize(sums.where("n > 0").withColumn("p_value", F.arrow_udf(tail, "double")(F.col("lost"), F.col("n"))))
    strata = tested.select("stratum").distinct().count()
    so_far = Window.partitionBy("stratum").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = tested.withColumn("ok", F.min(F.col("p_value") <= error / max(1, strata)).over(so_far)).where("ok")
    best = passed.groupBy("stratum").agg(F.max_by(F.struct("step", "n", "lost", "p_value"), F.struct(F.col("caught"), -F.col("step"))).alias("best"))
    return path.join(best.select("stratum", "best.*"), ["stratum", "step"]).select("stratum", "step", "cutoffs", "n", "lost", "p_value")


# ---------------------------------------------------------------- judging documents


def counted_texts(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Packed documents with (row, counts, stratum), read once by Python in small batches."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    return rows.select("row", counts_column(F.col("row.text")).alias("counts"), F.coalesce(F.col("row")[stratum].cast("string"), F.lit("")).alias("stratum"))


def fit_cutoffs(counted: DataFrame, labels: DataFrame, *, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Cutoffs from (doc_id, counts, stratum) and labels (doc_id, quality 0 or 1)."""
    told = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"))
    passing = counted.where(~base_failed(F.col("counts"))).select("doc_id", "stratum", F.array(*rule_values(F.col("counts"))).alias("values"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    labelled = materialize(passing.join(told, "doc_id").select("stratum", "values", "good", (fold == PROPOSES).alias("proposes")))
    return materialize(certified_cutoffs(labelled, risk=risk, error=error))


def judged(counted: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Rows with base_failed and kept. The table of cutoffs is small and written, so Spark knows its size and broadcasts it if that is below its limit."""
    rows = counted.join(cutoffs.select("stratum", "cutoffs"), "stratum", "left")
    failed = base_failed(F.col("counts"))
    rejected = F.coalesce(exceeds(F.array(*rule_values(F.col("counts"))), F.col("cutoffs")), F.lit(False))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & ~rejected).drop("cutoffs")


def rule_report(docs: DataFrame, labels: DataFrame, *, stratum: str = "lang") -> DataFrame:
    """One row per document: doc_id, COUNTS, base_failed, kept."""
    counted = counted_texts(docs.select("doc_id", "text", stratum), stratum)
    counted = materialize(counted.select("row.doc_id", "counts", "stratum"))
    return judged(counted, fit_cutoffs(counted, labels)).select("doc_id", "counts.*", "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, *, stratum: str = "lang") -> DataFrame:
    """The documents that the rules keep, with their columns; their texts are counted once for the cutoffs and once for the verdicts."""
    cutoffs = fit_cutoffs(counted_texts(docs.select("doc_id", "text", stratum), stratum).select("row.doc_id", "counts", "stratum"), labels)
    return judged(counted_texts(docs, stratum), cutoffs).where("kept").select("row.*")
