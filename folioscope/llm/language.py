"""Language identification with bit-sliced Bloom filters over n-grams.

Each slot of the filter holds one bit per language, so the AND of an n-gram's slots is the set of all
languages that contain it. A text's bits are counted per language, the counts are freed of what false
positives alone would give, and the language with the highest share of the text's n-grams wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import U64, materialize, mix, slabs, small_batches, text_bytes

UNDETERMINED = "und"
PREDICTION = "struct<lang_pred:string,score:double>"
PREDICTION_ARROW = [pa.field("lang_pred", pa.string()), pa.field("score", pa.float64())]


def _letter_codes() -> np.ndarray:
    codes = np.full(256, 32, np.uint8)
    for b in range(256):
        if 0x61 <= b <= 0x7A or b >= 0x80:
            codes[b] = b
        elif 0x41 <= b <= 0x5A:
            codes[b] = b + 32
    return codes


#: Letters lower-cased, all that isn't ASCII kept, the rest a space.
LETTER_CODES = _letter_codes()


def ngrams(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte n-grams as integers, and the offsets of each row's. Runs of other bytes count as one space."""
    codes = LETTER_CODES[data]
    capital = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
    codes[1:][capital] += 32  # capital letters of Latin-1
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    ends = np.concatenate(([0], np.cumsum(keep)))[offsets]
    codes = codes[keep]
    m = max(0, len(codes) - n + 1)
    grams = np.zeros(m, U64)
    for k in range(n):
        grams = (grams << U64(8)) | codes[k : k + m].astype(U64)
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    inside = row[:m] == row[n - 1 :]
    return grams[inside], np.concatenate(([0], np.cumsum(inside)))[np.minimum(ends, m)]


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows with a letter of any script."""
    latin = ((data | 32) >= 0x61) & ((data | 32) <= 0x7A)
    seen = np.concatenate(([0], np.cumsum(latin)))
    found = seen[offsets[1:]] > seen[offsets[:-1]]
    for r in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[r] = any(c.isalpha() for c in data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace"))
    return found


@dataclass
class LanguageModel:
    """languages: in order of their bits; table: slots x words of 64 languages; false: false-positive rate of each language."""

    languages: list[str]
    default: str | None
    n: int
    hashes: int
    table: np.ndarray
    false: np.ndarray

    @classmethod
    def of(cls, grams: dict[str, np.ndarray], default: str | None, n: int, hashes: int = 3) -> LanguageModel:
        languages = sorted(grams)
        most = max([64, *(len(g) for g in grams.values())])
        slots = 1 << int(np.ceil(np.log2(most * hashes / np.log(2))))
        model = cls(languages, default, n, hashes, np.zeros((slots, max(1, -(-len(languages) // 64))), U64), np.zeros(len(languages)))
        for i, language in enumerate(languages):
            for slot in model.slots(grams[language]):
                model.table[slot, i // 64] |= U64(1 << i % 64)
            fill = np.count_nonzero(model.table[:, i // 64] & U64(1 << i % 64)) / slots
            model.false[i] = fill**hashes
        return model

    def slots(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        first = mix(grams.copy())
        step = first >> U64(32) | U64(1)
        for k in range(self.hashes):
            yield ((first + step * U64(k)) & U64(len(self.table) - 1)).astype(np.int64)

    def shares(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Corrected share of each row's n-grams in each language: rows x languages."""
        grams, ends = ngrams(data, offsets, self.n)
        bits = None
        for slot in self.slots(grams):
            bits = self.table[slot] if bits is None else bits & self.table[slot]
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        total = np.maximum(np.diff(ends), 1)
        for i in range(len(self.languages)):
            held = np.concatenate(([0], np.cumsum(bits[:, i // 64] >> U64(i % 64) & U64(1), dtype=np.int64)))
            seen = held[ends[1:]] - held[ends[:-1]]
            out[:, i] = (seen / total - self.false[i]) / (1 - self.false[i])
        return np.clip(out, 0, 1)

    def predict(self, texts: pa.Array) -> pa.Array:
        data, offsets = text_bytes(texts)
        names = np.array([*self.languages, self.default, UNDETERMINED], object)
        labels, scores = [], []
        for lo, hi in slabs(offsets):
            piece, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            best = np.zeros(hi - lo, np.int64)
            score = np.zeros(hi - lo)
            if self.languages:
                shares = self.shares(piece, own)
                best, score = shares.argmax(1), shares.max(1)
            best[score == 0] = len(self.languages)
            silent = ~_has_letter(piece, own)
            best[silent] = len(self.languages) + 1
            score[silent] = 0
            labels += names[best].tolist()
            scores.append(score)
        return pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(np.concatenate([*scores, np.zeros(0)]))], fields=PREDICTION_ARROW)


def fit_language_model(labelled: DataFrame, *, n: int = 4, texts_per_language: int = 3000, least: float = 0.25) -> LanguageModel:
    """Learns from text and non-null lang of the given rows.

    Counts come from a sample of about texts_per_language distinct texts a language (all, where it has
    fewer), chosen by a hash of the text; copies of a text count once. A language keeps each n-gram of its sample
    whose rate there is at least `least` times the highest rate in any language. Null languages and
    texts are left out; without any rows the model has no language and predicts `und`. One row per
    language passes through the driver, and the n-grams that are kept, which the sample bounds: the filter that is broadcast
    grows with the languages, by some megabytes for each.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col("lang").alias("lang"), F.col("text").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    marked = rows.groupBy("lang", F.xxhash64("text").alias("mark")).agg(F.count("*").alias("times"))
    sizes = {r["lang"]: (r["texts"], r["rows"]) for r in marked.groupBy("lang").agg(F.count("*").alias("texts"), F.sum("times").alias("rows")).collect()}  # one row a language
    if not sizes:
        return LanguageModel.of({}, UNDETERMINED, n)
    spread = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    size = F.element_at(F.create_map(*(F.lit(x) for lang, (texts, _) in sizes.items() for x in (lang, texts))), F.col("lang"))
    sample = rows.where(spread * size < texts_per_language).distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            data, offsets = text_bytes(batch.column(1))
            index = langs.indices.to_numpy()
            for lo, hi in slabs(offsets):
                grams, ends = ngrams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n)
                of = np.repeat(index[lo:hi], np.diff(ends))
                for i in np.unique(of):
                    found, times = np.unique(grams[of == i], return_counts=True)
                    name = pa.array([langs.dictionary[int(i)].as_py()] * len(found), pa.string())
                    yield pa.RecordBatch.from_arrays([name, pa.array(found.astype(np.int64)), pa.array(times)], names=["lang", "gram", "times"])

    counts = materialize(sample.mapInArrow(count, "lang string, gram long, times long").groupBy("lang", "gram").agg(F.sum("times").alias("times")))
    totals = counts.groupBy("lang").agg(F.sum("times").alias("total"))
    rates = counts.join(totals, "lang").select("lang", "gram", (F.col("times") / F.col("total")).alias("rate"))
    tops = rates.groupBy("gram").agg(F.max("rate").alias("top"))
    kept = rates.join(tops, "gram").where(F.col("rate") >= least * F.col("top"))
    grams = {r["lang"]: np.array(r["grams"], np.int64).astype(U64) for r in kept.groupBy("lang").agg(F.collect_list("gram").alias("grams")).collect()}
    return LanguageModel.of(grams, min(sizes, key=lambda x: (-sizes[x][1], x)), n)


def predict_language(docs: DataFrame, model: LanguageModel, text: str = "text") -> Column:
    """Struct column (lang_pred, score) of a text column. Null texts and texts without a letter are `und` with
    score 0; a text without a known n-gram gets the model's most common language with score 0. Of languages with
    equal shares the first by code point wins. Repeated rows are predicted each."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(texts: pa.Array) -> pa.Array:
        return held.value.predict(texts)

    return F.arrow_udf(predict, PREDICTION)(F.col(text))
