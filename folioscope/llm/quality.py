"""Quality scores from a sparse rule ensemble over text statistics.

Boosted shallow trees over the statistics of labelled texts give paths; each path is a conjunction of
comparisons, a rule. A logistic model with a lasso penalty weighs the rules, most of them with zero.
The rules that stay are compiled into one Spark column expression over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import Words, slabs, small_batches, text_bytes

STATISTICS = (
    "bytes", "words", "word_length", "letters", "capitals", "digits", "marks", "blanks", "line_ends", "other",
    "distinct_words", "top_word", "line_length", "short_lines", "repeated_lines", "marks_at_word_end", "doubled_marks", "capital_words",
)
#: Labelled rows that a fit takes at most (about; chosen by a hash of the id).
MOST_LABELS = 20_000
LIKELY = 0.7

#: (statistic, is it at most the threshold, threshold)
Condition = tuple[int, bool, float]
Rule = tuple[Condition, ...]


def _classes() -> np.ndarray:
    """Class of each byte: 0 lower letter, 1 capital, 2 digit, 3 mark, 4 blank, 5 line end, 6 other."""
    out = np.full(256, 6, np.uint8)
    for b in range(128):
        c = chr(b)
        out[b] = 5 if c == "\n" else 4 if c.isspace() else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if b > 32 and b < 127 else 6
    return out


BYTE_CLASS = _classes()


def _share(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def text_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Statistics of each row: rows x STATISTICS, all finite; an empty text has zeros."""
    n = len(offsets) - 1
    kind = BYTE_CLASS[data]
    size = np.diff(offsets).astype(float)
    full = np.maximum(size, 1)
    words = Words(data, offsets)
    count = np.diff(words.first).astype(float)
    some = np.maximum(count, 1)
    lengths = words.ends - words.starts
    out = np.zeros((n, len(STATISTICS)))
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(count)
    out[:, 2] = _share(np.bincount(words.starts, lengths, len(data)) if len(lengths) else np.zeros(len(data)), offsets) / some
    for k in range(7):
        out[:, 3 + k] = _share(kind == k, offsets) / full
    mark = kind == 3
    closes = np.zeros(len(data), bool)
    inner = words.ends[words.ends < len(data)]
    closes[inner] = mark[inner]
    doubled = np.zeros(len(data), bool)
    doubled[1:] = mark[1:] & (data[1:] == data[:-1])
    out[:, 15] = _share(closes, offsets) / some
    out[:, 16] = _share(doubled, offsets) / some
    capital = np.zeros(len(data), bool)
    long_ = lengths > 1
    capital[words.starts[long_]] = (kind[words.starts[long_]] == 1) & (kind[words.starts[long_] + 1] == 1)
    out[:, 17] = _share(capital, offsets) / some
    for r in range(n):
        a, b = words.first[r], words.first[r + 1]
        if b > a:
            times = np.unique(words.hashes[a:b], return_counts=True)[1]
            out[r, 10], out[r, 11] = len(times) / (b - a), times.max() / (b - a)
        lines = [x for x in data[offsets[r] : offsets[r + 1]].tobytes().split(b"\n") if x]
        if lines:
            out[r, 12] = np.log1p(size[r] / len(lines))
            out[r, 13] = sum(len(x) < 30 for x in lines) / len(lines)
            out[r, 14] = 1 - len(set(lines)) / len(lines)
    return out


def statistics_column(text: Column) -> Column:
    """Array column of the statistics of a text; null is empty."""

    def measure(texts: pa.Array) -> pa.Array:
        data, offsets = text_bytes(texts)
        parts = [text_statistics(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in slabs(offsets)]
        flat = np.concatenate(parts).ravel() if parts else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(STATISTICS), dtype=np.int32)), pa.array(flat))

    return F.arrow_udf(measure, "array<double>")(text)


# ---------------------------------------------------------------- trees, rules, lasso (on a bounded sample)


def _grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, depth: int, least: int, path: Rule, rules: set[Rule], leaf: np.ndarray) -> None:
    """Splits rows by the best threshold and notes the path to each node; leaf gets the values of the tree."""
    if path:
        rules.add(tuple(sorted(path)))
    g, h = gradient[rows].sum(), hessian[rows].sum()
    leaf[rows] = g / (h + 1.0)
    if depth == 0 or len(rows) < 2 * least:
        return
    best, choice = 1e-6, None
    for f in range(x.shape[1]):
        values = x[rows, f]
        cuts = np.unique(np.quantile(values, np.linspace(0.02, 0.98, 33)))
        if len(cuts) < 2:
            continue
        slot = np.searchsorted(cuts, values, "left")  # values at most cuts[k] have slots up to k
        gs = np.cumsum(np.bincount(slot, gradient[rows], len(cuts) + 1))[:-1]
        hs = np.cumsum(np.bincount(slot, hessian[rows], len(cuts) + 1))[:-1]
        ns = np.cumsum(np.bincount(slot, minlength=len(cuts) + 1))[:-1]
        gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
        gain[(ns < least) | (len(rows) - ns < least)] = 0
        k = int(gain.argmax())
        if gain[k] > best:
            best, choice = gain[k], (f, float(cuts[k]))
    if choice is None:
        return
    f, cut = choice
    low = x[rows, f] <= cut
    _grow(x, gradient, hessian, rows[low], depth - 1, least, (*path, (f, True, cut)), rules, leaf)
    _grow(x, gradient, hessian, rows[~low], depth - 1, least, (*path, (f, False, cut)), rules, leaf)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, seed: int = 7) -> list[Rule]:
    """Paths of boosted trees, each grown on a random half of the rows."""
    random = np.random.default_rng(seed)
    rules: set[Rule] = set()
    score = np.zeros(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        rows = np.flatnonzero(random.random(len(y)) < 0.5)
        leaf = np.zeros(len(y))
        own: set[Rule] = set()
        _grow(x, y - p, p * (1 - p), rows, depth, max(3, len(rows) // 200), (), own, leaf)
        rules |= own
        score += rate * leaf
    return sorted(rules)


def rule_values(x: np.ndarray, rules: list[Rule]) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for f, at_most, cut in rule:
            out[:, j] *= (x[:, f] <= cut) if at_most else (x[:, f] > cut)
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic model with an L1 penalty on the weights, by accelerated proximal steps."""
    n, m = z.shape
    design = np.hstack([z, np.ones((n, 1))])
    width = np.linalg.norm(design, 2) ** 2 / (4 * n) + 1e-9
    w = v = np.zeros(m + 1)
    t = 1.0
    for _ in range(steps):
        slope = design.T @ (1 / (1 + np.exp(-design @ v)) - y) / n
        new = v - slope / width
        new[:m] = np.sign(new[:m]) * np.maximum(np.abs(new[:m]) - penalty / width, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / after * (new - w)
        w, t = new, after
    return w[:m], float(w[m])


@dataclass
class RuleEnsemble:
    """Rules with weights that aren't zero, and the intercept."""

    rules: list[Rule]
    weights: list[float]
    intercept: float

    def column(self, statistics: Column) -> Column:
        """The score as a column expression over an array of statistics."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            fits = None
            for f, at_most, cut in rule:
                one = F.get(statistics, F.lit(f)) <= cut if at_most else F.get(statistics, F.lit(f)) > cut
                fits = one if fits is None else fits & one
            total = total + F.when(fits, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def describe(self) -> list[str]:
        """The rules in words, strongest first."""
        text = [" and ".join(f"{STATISTICS[f]} {'<=' if low else '>'} {cut:.4g}" for f, low, cut in rule) for rule in self.rules]
        return [f"{w:+.3f} if {t}" for w, t in sorted(zip(self.weights, text, strict=True), key=lambda x: -abs(x[0]))]


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = 0.002) -> RuleEnsemble:
    """Without labels of both kinds the ensemble has no rule: it scores the share of label 1 (0.5 without labels)."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleEnsemble([], [], float(np.log(share / (1 - share))))
    rules = tree_rules(x, y)
    weights, intercept = lasso_logistic(rule_values(x, rules), y, penalty)
    kept = np.flatnonzero(np.abs(weights) > 1e-6)
    return RuleEnsemble([rules[k] for k in kept], weights[kept].tolist(), intercept)


def fit_quality(docs: DataFrame, labels: DataFrame, *, most: int = MOST_LABELS) -> RuleEnsemble:
    """Fits documents (doc_id, text) to labels (doc_id, quality 0 or 1).

    At most about `most` labelled ids are used, chosen by a hash of the id; rows of other ids are left
    out on both sides before anything is joined. An id counts once: of several labels the largest, of several texts that of the
    smallest statistics. Null ids, null labels and labels without a document are left out.
    """
    small_batches(docs.sparkSession)
    labelled = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("quality")).where("id IS NOT NULL AND quality IS NOT NULL")
    labelled = labelled.groupBy("id").agg(F.max("quality").alias("quality"))
    share = min(1.0, most / max(1, labelled.count()))
    drawn = F.pmod(F.xxhash64(F.col("id").cast("long")), F.lit(1 << 20)) < share * (1 << 20)
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("text")).where(drawn & F.col("id").isNotNull())
    measured = texts.select("id", statistics_column(F.col("text")).alias("statistics")).groupBy("id").agg(F.min("statistics").alias("statistics"))
    rows = measured.join(labelled.where(drawn), "id").orderBy("id").select("statistics", "quality").collect()
    x = np.array([r["statistics"] for r in rows]).reshape(len(rows), len(STATISTICS))
    return fit_rules(x, np.array([r["quality"] for r in rows]))


def quality_scores(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """One row per document: doc_id, score (0 to 1; null and empty texts are scored by their statistics, all 0), predicted.

    Repeated rows are scored each; a null doc_id is scored like others, and other columns are left out, whatever their names.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", statistics_column(F.col("text")).alias("statistics"))
    scored = rows.select("doc_id", model.column(F.col("statistics")).alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= LIKELY).cast("int").alias("predicted"))
