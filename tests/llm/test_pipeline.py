import random
from hashlib import md5

import corpus_pipeline
from test_decontaminate import brute as contaminated
from test_jaccard_join import brute as groups
from test_suffix_dedup import brute as repeats

WORDS = {
    "en": "the house hill river very old nobody knew who had built there stone water light morning winter garden window".split(),
    "de": "das haus hügel fluss sehr alt niemand wusste wer hatte gebaut dort stein wasser licht morgen winter garten fenster".split(),
    "fr": "la maison colline rivière très vieille personne savait qui avait bâti pierre eau lumière matin hiver jardin fenêtre".split(),
}


def corpus(seed=4):
    r = random.Random(seed)
    prose = lambda lang, n: " ".join(r.choice(WORDS[lang]) + str(r.randint(0, 9)) * (r.random() < 0.3) for _ in range(n))
    docs = [(i, prose(lang := r.choice(list(WORDS)), r.randint(30, 120)), lang, r.choice("abc")) for i in range(60)]
    items = [(i, prose("en", r.choice([4, 12, 30]))) for i in range(6)]
    passage = prose("fr", 40)
    docs += [(100 + i, docs[i][1], docs[i][2], "b") for i in range(5)]
    docs += [(110 + i, docs[i][1] + " more", docs[i][2], "c") for i in range(5)]
    docs += [(120 + i, prose("fr", 40) + ". " + passage + ". " + prose("fr", 30), "fr", None) for i in range(4)]
    docs += [(130 + i, prose("en", 20) + " " + items[i][1] + " " + prose("en", 20), "en", "a") for i in range(6)]
    docs += [(140, "12345 67890 !!!", "en", "a"), (141, None, "en", "a"), (142, "", None, "a"), (143, "Ωψφ " * 60, None, "b"), (144, "da", "de", "b")]
    return docs, items


def mix(docs):
    """{doc_id: copies} by water filling and the hash of the id."""
    size = {d: len((t or "").split()) for d, t, *_ in docs}
    sums = {}
    for d, *_, source in docs:
        sums[source] = sums.get(source, 0) + size[d]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sums, key=lambda s: (s is None, s or "")))}
    capped, free = {}, set(sums)
    while True:
        level = (sum(sums.values()) - sum(capped.values())) / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * level > 3 * sums[s]}
        if not above:
            break
        capped |= {s: 3 * sums[s] for s in above}
        free -= above
    out = {}
    for d, *_, source in docs:
        rate = min(3 * sums[source], weight[source] * level) / sums[source]
        draw = int(md5(f"mix:{d}".encode()).hexdigest()[:8], 16) / 2**32
        out[d] = int(rate) + (draw < rate - int(rate))
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs, items = corpus()
    frame = spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [d for d in docs if d[0] not in (140, 141, 142, 143)]  # in none of the three languages
    left = [d for d in left if groups([(d[0], d[1]) for d in left])[d[0]][0] == d[0]]
    cut = repeats(sorted((d[0], d[1]) for d in left))
    left = [(d[0], cut[d[0]][4].decode("utf-8", "ignore"), *d[2:]) for d in left if not cut[d[0]][1] or cut[d[0]][4]]
    clean = {r[0] for r in contaminated([d[:2] for d in left], items) if not r[5]}
    left = [d for d in left if d[0] in clean]
    times = mix(left)
    want = sorted((d[0], d[1], d[3], len(d[1]), k + 1) for d in left for k in range(times[d[0]]))

    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"]
    assert sorted((r["doc_id"], r["text"], r["source"], r["n_chars"], r["copy"]) for r in got.collect()) == want
    assert {100, 101, 110, 111, 130, 140} - {d[0] for d in left} == {100, 101, 110, 111, 130, 140}


def test_stages_keep_columns_and_survive_empty_tables(spark, documents, odd_rows, tmp_path):
    spark.createDataFrame([(1, "some text of the benchmark")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in ([], odd_rows):
        docs = documents(rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns if name != "sources" else out.columns[:-1] == docs.columns
            assert rows or out.count() == 0
            docs = docs if name == "sources" else spark.createDataFrame(out.collect(), out.schema)
