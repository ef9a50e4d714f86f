import collections
import random
import re
import zlib
from collections import Counter

import pyarrow as pa

from folioscope.llm.common import text_bytes
from folioscope.llm.language import fit_language_model, predict_language
from folioscope.llm.queries import QUERIES

SAMPLES = {
    "en": "the house on the hill was very old and nobody knew who had built it there",
    "de": "das alte haus auf dem hügel war sehr alt und niemand wusste wer es gebaut hatte",
    "fr": "la vieille maison sur la colline était très ancienne et personne ne savait qui l'avait bâtie",
}


def labelled(documents):
    return documents([(10 * i + j, t + f" {j}", lang, None) for i, (lang, t) in enumerate(SAMPLES.items()) for j in range(6)])


def predictions(df, model):
    return [tuple(r) for r in df.select("doc_id", predict_language(df, model).alias("p")).select("doc_id", "p.*").orderBy("doc_id").collect()]


def test_predicts_what_it_learned(spark, documents):
    model = fit_language_model(labelled(documents))
    assert model.languages == ["de", "en", "fr"]
    got = predictions(documents([(1, "the old house was there"), (2, "das haus war alt"), (3, "LA MAISON ÉTAIT TRÈS VIEILLE")]), model)
    assert [g[1] for g in got] == ["en", "de", "fr"] and all(0 < g[2] <= 1 for g in got)


def test_odd_rows(spark, documents, odd_rows):
    model = fit_language_model(labelled(documents))
    got = {g[0]: g[1:] for g in predictions(documents(odd_rows), model)}
    assert got[3] == got[4] == got[5] == got[8] == ("und", 0.0)
    assert got[6][0] in model.languages


def test_without_labels(spark, documents, odd_rows):
    model = fit_language_model(documents([(1, None, "en", None), (2, "text", None, None)]))
    assert {g[1] for g in predictions(documents(odd_rows), model)} == {"und"}
    assert predictions(documents([]), fit_language_model(documents([]))) == []


def test_more_than_64_languages(spark, documents):
    import random

    rows = []
    for i in range(70):
        r = random.Random(i)
        syllables = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(12)]
        rows += [(100 * i + j, " ".join(r.choice(syllables) for _ in range(40)), f"l{i:02}", None) for j in range(3)]
    docs = documents(rows)
    model = fit_language_model(docs)
    assert model.table.shape[1] == 2
    assert sum(p[1] == f"l{p[0] // 100:02}" for p in predictions(docs, model)) == len(rows)


def brute_shares(texts, samples, n=4, least=0.25):
    """Share of a text's n-grams in each language, with sets in place of the Bloom filters."""

    def grams(text):
        out = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" else c if c.isalpha() and c.isascii() or ord(c) > 127 else " " for c in text)
        raw = re.sub(" +", " ", out).encode()
        return [raw[i : i + n] for i in range(len(raw) - n + 1)]

    counts = {lang: collections.Counter(g for t in set(own) for g in grams(t)) for lang, own in samples.items()}
    rates = {lang: {g: k / sum(c.values()) for g, k in c.items()} for lang, c in counts.items()}
    top = collections.Counter()
    for r in rates.values():
        top |= collections.Counter(r)
    kept = {lang: {g for g, x in r.items() if x >= least * top[g]} for lang, r in rates.items()}
    return [{lang: sum(g in k for g in grams(t)) / max(1, len(grams(t))) for lang, k in kept.items()} for t in texts]


def test_shares_match_brute_force(spark, documents):
    """Bloom filters, popcounts and their correction against plain sets: equal but for false positives."""
    samples = {lang: [t + f" {j}" for j in range(6)] + [t + " 0"] for lang, t in SAMPLES.items()}
    model = fit_language_model(documents([(10 * i + j, t, lang, None) for i, (lang, own) in enumerate(samples.items()) for j, t in enumerate(own)]))
    texts = ["the old house was there", "DAS HAUS war alt; la maison", "LA MAISON ÉTAIT TRÈS VIEILLE", "nothing of that sort, zzzz qqqq", "xy"]
    data, offsets = text_bytes(pa.array(texts))
    for got, want in zip(model.shares(data, offsets), brute_shares(texts, samples), strict=True):
        assert all(abs(got[i] - want[lang]) < 0.06 for i, lang in enumerate(model.languages))
    assert max(model.false) < 0.2
    for got, want in zip(predictions(documents(list(enumerate(texts[:3]))), model), brute_shares(texts[:3], samples), strict=True):
        assert got[1] == max(want, key=want.get)


def test_each_language_keeps_its_ngrams(spark, documents):
    """A language of one text, and one whose n-grams are all equally frequent."""
    docs = documents([(1, "abcdefghijklmnopqrstuvwxyz", "aa", None), (2, "zyxwvu tsrqpo nmlkji", "bb", None), (3, "zyxwvu tsrqpo nmlkji", "bb", None)])
    model = fit_language_model(docs)
    assert model.languages == ["aa", "bb"]
    assert [p[1] for p in predictions(docs, model)] == ["aa", "bb", "bb"]


# ---------------------------------------------------------------- the whole query


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def corpus():
    r = random.Random(8)
    words = {"en": "the of and that with which thing house water".split(), "de": "der die und nicht mit welche haus wasser schön".split(), "es": "el la que con cosa casa agua señor niño".split()}
    rows = [(i, " ".join(r.choices(words[lang := "en de es".split()[i % 3]], k=r.randrange(3, 30))) + "!", lang) for i in range(240)]
    return [*rows, (240, None, "en"), (241, "", "de"), (242, "12 34", None), (243, "東京 みず", None), (244, "zzz qqq", "en"), (245, "the water and die Wasser", None)]


def run_query(spark, folder, rows):
    spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return {r["doc_id"]: r for r in QUERIES["op8_language"](spark, str(folder)).collect()}


def grams(text, n=4):
    """Byte n-grams of a text: letters in lower case, runs of other ASCII as one space."""
    low = "".join(c.lower() if c.isascii() or "À" <= c <= "Þ" else c for c in text)
    raw = re.sub(rb"[^a-z\x80-\xff]+", b" ", low.encode())
    return [raw[i : i + n] for i in range(len(raw) - n + 1)]


def test_query_equals_brute_force(spark, tmp_path):
    """Exact sets in place of the filters: a share differs by what false positives leave, so the same language wins unless two are that close."""
    rows = corpus()
    got = run_query(spark, tmp_path, rows)
    counts = {}
    for lang in ("de", "en", "es"):
        counts[lang] = Counter(g for t in {t for i, t, own in rows if own == lang and t is not None and not held(i)} for g in grams(t))
    rate = {lang: {g: k / c.total() for g, k in c.items()} for lang, c in counts.items()}
    top = {g: max(r.get(g, 0) for r in rate.values()) for r in rate.values() for g in r}
    known = {lang: {g for g, x in r.items() if x >= 0.25 * top[g]} for lang, r in rate.items()}
    assert len(got) == len(rows)
    compared = 0
    for i, text, _ in rows:
        assert got[i]["held_out"] == held(i)
        if not text or not any(c.isalpha() for c in text):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
            continue
        own = grams(text)
        shares = sorted(((sum(g in known[lang] for g in own) / max(1, len(own)), lang) for lang in known), reverse=True)
        assert abs(got[i]["score"] - shares[0][0]) < 0.15
        if shares[0][0] - shares[1][0] > 0.3:
            compared += 1
            assert got[i]["lang_pred"] == shares[0][1]
    assert compared > 200


def test_languages_of_the_held_out_fold_change_nothing(spark, tmp_path):
    rows = corpus()
    first = run_query(spark, tmp_path / "a", rows)
    turned = run_query(spark, tmp_path / "b", [(i, t, {"en": "de", "de": "xx", "es": None}.get(lang) if held(i) else lang) for i, t, lang in rows])
    assert {i: tuple(r) for i, r in first.items()} == {i: tuple(r) for i, r in turned.items()} and sum(map(held, first)) > 30
