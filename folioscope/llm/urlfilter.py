"""URL filters: rules by host and path, and naive Bayes over segmented names for what no rule decides.

Host labels and path parts are names without blanks; a unigram Viterbi search over word counts of the
page texts splits them into words. A multinomial naive Bayes model learns from the pages that the rules
decide and scores the words of the others.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import Words, materialize, slabs, small_batches, text_bytes

ALLOW, BLOCK = "allow", "block"
#: (host, path, verdict): a rule fits its host and all subdomains, if the path starts with the rule's.
Rule = tuple[str, str, str]
RULES: list[Rule] = [("org", "/", ALLOW), ("example.org", "/es/", BLOCK), ("example.org", "/en/1", BLOCK), ("com", "/fr/", ALLOW), ("com", "/de/", BLOCK)]
#: Letters of a name that are worked on at once, and letters of the substrings that are looked up whole; longer words are
#: found by their first SEED letters. Neither bounds a name or a word.
BLOCK_LETTERS, SEED = 2048, 64


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null where none does; of equally long ones the first of the given order."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(reversed(rules), key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


@dataclass
class Segmenter:
    """Splits names into the words of highest probability; what no word covers costs more with each letter."""

    costs: dict[str, float]
    unknown: float
    seen: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.lengths = sorted({len(w) for w in self.costs})

    @classmethod
    def of(cls, counts: dict[str, int], total: int | None = None) -> Segmenter:
        """Costs from counts; total: of all words, where counts are only a part of them."""
        total = sum(counts.values()) if total is None else total
        total = total or 1
        return cls({w: -math.log(n / total) for w, n in counts.items()}, math.log(10 * total))

    def split(self, name: str) -> list[str]:
        if name not in self.seen:
            if len(self.seen) > 100_000:
                self.seen.clear()
            self.seen[name] = self._viterbi(name)
        return self.seen[name]

    def _viterbi(self, name: str) -> list[str]:
        """Best costs up to each letter: the last word is known, of one of the lengths that known words have, or unknown and of any
        length. Its cost is linear in its length, so one running minimum tells where it begins best. Of equal costs the earliest beginning counts."""
        best, back, reach = [0.0], [0], (0.0, 0)
        for end in range(1, len(name) + 1):
            cost, start = reach[0] + self.unknown + 3.0 * end, reach[1]
            for size in self.lengths:
                if size > end:
                    break
                word = self.costs.get(name[end - size : end])
                if word is not None and (best[end - size] + word, end - size) < (cost, start):
                    cost, start = best[end - size] + word, end - size
            best.append(cost)
            back.append(start)
            reach = min(reach, (cost - 3.0 * end, end))
        words, end = [], len(name)
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        return words[::-1]

    def tokens(self, host: str, path: str) -> list[str]:
        """Words of host labels (`h:`) and path parts (`p:`); numbers count by their length."""
        out = []
        for kind, text in (("h", host), ("p", path.lower())):
            for part in re.findall(r"[a-z]+|[0-9]+", text):
                out += [f"{kind}:{'#' * len(part)}"] if part[0].isdigit() else [f"{kind}:{w}" for w in self.split(part)]
        return out


@dataclass
class UrlModel:
    """words: (word, times) of all page texts; total: the sum of times. weights: (token, weight), log-odds of a word being in
    blocked URLs; prior: log-odds of a blocked URL."""

    words: DataFrame
    total: int
    weights: DataFrame
    prior: float

    def odds(self, host: str, path: str) -> float:
        """The log-odds of one URL, on the driver; url_verdicts joins instead."""
        names = re.findall(r"[a-z]+", host) + re.findall(r"[a-z]+", path.lower())
        inner = {n[i:j] for n in names for i in range(len(n)) for j in range(i + 1, len(n) + 1)}
        costs = self.words.where(F.col("word").isin(*inner)).collect() if inner else []
        tokens = Segmenter.of({r["word"]: r["times"] for r in costs}, self.total).tokens(host, path)
        weights = {r["token"]: r["weight"] for r in self.weights.where(F.col("token").isin(*set(tokens))).collect()} if tokens else {}
        return self.prior + sum(weights.get(t, 0.0) for t in tokens)


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """(word, times) of all words of ASCII letters in all texts of a column."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for lo, hi in slabs(offsets):
                words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1])
                _, at, times = np.unique(words.hashes, return_index=True, return_counts=True)
                names = [words.codes[a:b].tobytes() for a, b in zip(words.starts[at], words.ends[at], strict=True)]
                plain = [(n.decode(), int(t)) for n, t in zip(names, times, strict=True) if n.isalpha()]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in plain], pa.string()), pa.array([t for _, t in plain], pa.int64())], names=["word", "times"])

    return texts.select(F.col(column).cast("string")).mapInArrow(count, "word string, times long").groupBy("word").agg(F.sum("times").alias("times"))


def known_words(names: DataFrame, words: DataFrame) -> DataFrame:
    """(key, found: array of (word, times)): the known words that occur in each name (key, name).

    Names are cut into blocks that overlap by a seed, so a row never holds more than the substrings of a block, at the lengths that known
    words have. Words longer than a seed are proposed by their first letters and then looked for in the whole name.
    """
    sizes = words.agg(F.collect_set(F.when(F.char_length("word") <= SEED, F.char_length("word"))).alias("short"), F.max(F.char_length("word")).alias("longest")).first()
    cuts = F.sequence(F.lit(0), F.floor((F.char_length("name") - 1) / BLOCK_LETTERS).cast("int"))
    blocks = names.select("key", F.explode(F.transform(cuts, lambda i: F.substring("name", i * BLOCK_LETTERS + 1, F.lit(BLOCK_LETTERS + SEED - 1)))).alias("block"))
    places = F.sequence(F.lit(1), F.least(F.char_length("block"), F.lit(BLOCK_LETTERS)))
    lengths = F.array(*map(F.lit, sorted(sizes["short"]))).cast("array<int>")
    inner = F.array_distinct(F.flatten(F.transform(places, lambda i: F.transform(lengths, lambda n: F.substring("block", i, n)))))
    found = blocks.select("key", F.explode(inner).alias("word")).join(words.where(F.char_length("word") <= SEED), "word").select("key", "word", "times")
    if (sizes["longest"] or 0) > SEED:
        begun = F.filter(F.transform(places, lambda i: F.substring("block", i, F.lit(SEED))), lambda x: F.char_length(x) == SEED)
        seeds = blocks.select("key", F.explode(F.array_distinct(begun)).alias("seed")).distinct()
        long_ = words.where(F.char_length("word") > SEED).withColumn("seed", F.substring("word", 1, SEED))
        proposed = seeds.join(long_, "seed").join(names, "key").where(F.contains("name", F.col("word")))
        found = found.unionByName(proposed.select("key", "word", "times"))
    return found.groupBy("key").agg(F.collect_set(F.struct("word", "times")).alias("found"))


def split_names(names: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """(name, words) of distinct names (name), each split with the counts of its own substrings only."""

    def split(name: pa.Array, found: pa.Array) -> pa.Array:
        rows = zip(name.to_pylist(), found.to_pylist(), strict=True)
        return pa.array([Segmenter.of({f["word"]: f["times"] for f in own}, total).split(n) for n, own in rows], pa.list_(pa.string()))

    keyed = names.select("name", F.sha2("name", 256).alias("key"))
    rows = keyed.join(known_words(keyed, words), "key", "left").select("name", F.coalesce("found", F.array().cast("array<struct<word:string,times:bigint>>")).alias("found"))
    # Written before it is joined to the names of all URLs, so that Spark can split names that most hosts have.
    return materialize(rows.select("name", F.arrow_udf(split, "array<string>")("name", "found").alias("words")))


def url_key(host: Column, path: Column) -> Column:
    """One short key for a host and path, so that rows of tokens don't carry a long URL; a host has no slash, a path begins with one or is empty."""
    return F.sha2(F.concat(host, path), 256)


def url_tokens(parts: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """(key, token) of distinct parts (key, host, path), a row for each time that a token occurs."""
    pieces = lambda kind, text: F.transform(F.regexp_extract_all(text, F.lit("[a-z]+|[0-9]+"), F.lit(0)), lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("name")))
    both = parts.select("key", F.concat(pieces("h", F.col("host")), pieces("p", F.lower("path"))).alias("pieces"))
    both = materialize(both.select("key", F.explode("pieces").alias("piece")).select("key", "piece.*"))
    number = F.col("name").rlike("^[0-9]")
    numbers = both.where(number).select("key", F.concat("kind", F.lit(":"), F.repeat(F.lit("#"), F.char_length("name"))).alias("token"))
    names = both.where(~number)
    split = split_names(names.select("name").distinct(), words, total)
    spelt = names.join(split, "name").select("key", "kind", F.explode("words").alias("word")).select("key", F.concat("kind", F.lit(":"), "word").alias("token"))
    return numbers.unionByName(spelt)


def fit_url_model(pages: DataFrame, rules: Sequence[Rule] = RULES, *, seeds: Mapping[str, int] | None = None) -> UrlModel:
    """Learns words from all page texts (html), and verdicts from all pages that a rule decides.

    Words and tokens stay tables of Spark, so the model knows all of them; only sums reach the driver.
    seeds: host words that count as seen so often in blocked URLs, where a list of one's own is at hand.
    Tokens that no decided URL has say nothing. Without decided pages and seeds all others are allowed.
    """
    small_batches(pages.sparkSession)
    counts = materialize(word_counts(pages, "html"))
    total = counts.agg(F.sum("times")).first()[0] or 0
    parts = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    decided = parts.select("host", "path", rule_of(F.col("host"), F.col("path"), rules)["verdict"].alias("verdict")).where("verdict IS NOT NULL")
    blocked, allowed = (F.sum(F.when(F.col("verdict") == v, 1).otherwise(0)).alias(n) for v, n in ((BLOCK, "b"), (ALLOW, "a")))
    decided = materialize(decided.groupBy("host", "path").agg(blocked, allowed).withColumn("key", url_key(F.col("host"), F.col("path"))))
    tokens = url_tokens(decided.select("key", "host", "path"), counts, total).join(decided.select("key", "b", "a"), "key").select("token", "b", "a")
    given = pages.sparkSession.createDataFrame([(f"h:{s}", n, 0) for s, n in (seeds or {}).items()], "token string, b long, a long")
    seen = materialize(tokens.unionByName(given).groupBy("token").agg(F.sum("b").alias("b"), F.sum("a").alias("a")))
    b_total, a_total, n = seen.agg(F.sum("b"), F.sum("a"), F.count("*")).first()
    weights = seen.select("token", (F.log((F.col("b") + 1) / float((b_total or 0) + n)) - F.log((F.col("a") + 1) / float((a_total or 0) + n))).alias("weight"))
    b_pages, a_pages = decided.agg(F.sum("b"), F.sum("a")).first()
    return UrlModel(counts, total, materialize(weights), math.log(((b_pages or 0) + 1) / ((a_pages or 0) + 1)))


def url_verdicts(pages: DataFrame, model: UrlModel, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, block_odds (the model's log-odds, also where a rule decides).

    host and path are empty for a null URL and for one without `://`; such pages get the model's prior. Odds of 0 allow. Repeated
    rows are judged each; other columns of the pages are left out, whatever their names. URLs of any length are split whole.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("key", url_key(F.col("host"), F.col("path")))
    scored = url_tokens(rows.select("key", "host", "path").distinct(), model.words, model.total).join(model.weights, "token").groupBy("key").agg(F.sum("weight").alias("odds"))
    scored = materialize(scored)
    rows = rows.join(scored, "key", "left")
    rows = rows.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("found"), (F.lit(model.prior) + F.coalesce("odds", F.lit(0.0))).alias("block_odds"))
    verdict = F.coalesce("found.verdict", F.when(F.col("block_odds") > 0, BLOCK).otherwise(ALLOW))
    return rows.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "block_odds")
