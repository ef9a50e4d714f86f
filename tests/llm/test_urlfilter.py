import collections
import math
import re

from folioscope.llm.urlfilter import RULES, Segmenter, fit_url_model, url_verdicts


def brute_rule(host, path):
    fits = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def split(url):
    m = re.match(r".*?://([^/?#]*)([^?#]*)", url or "", re.S)
    return ("", "") if not m else ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2])


URLS = [
    "http://A.Example.ORG/es/1", "https://x.example.org/en/12?q=1", "http://example.org/en/2#x", "http://org", "http://org/", "http://notexample.org/es/", "http://foo.com/fr/", "http://foo.com/frx", "http://foo.com/de/1",
    "http://foo.net/en/1", None, "", "no scheme/at/all", "a://b://c/d", "http://casinowin.net/", "http://quiethouse.net/en/", "http://ü.net/ünï", "http:///x", "mailto:x@y.z", "http://h.com?x=/fr/",
]


def table(spark):
    rows = [(i, u, "<p>casino win quiet house house quiet</p>", "own", "own") for i, u in enumerate(URLS)] + [(None, URLS[0], None, "own", "own"), (0, URLS[0], "", "own", "own")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, verdict string")


def test_rules_and_parts(spark):
    pages = table(spark)
    model = fit_url_model(pages)
    got = url_verdicts(pages, model).collect()
    assert len(got) == pages.count()
    for r in got:
        host, path = split(URLS[r["page_id"] or 0])
        assert (r["host"], r["path"]) == (host, path)
        rule, verdict = brute_rule(host, path)
        assert r["rule"] == rule
        assert abs(r["block_odds"] - model.odds(host, path)) < 1e-9
        assert r["verdict"] == (verdict or ("block" if r["block_odds"] > 0 else "allow"))


def test_unknown_hosts_are_judged_by_their_words(spark):
    pages = table(spark)
    seeds = {"casino": 20, "win": 20}
    got = {r["page_id"]: r["verdict"] for r in url_verdicts(pages, fit_url_model(pages, seeds=seeds)).collect()}
    assert got[URLS.index("http://casinowin.net/")] == "block"


def brute_tokens(host, path, counts):
    """All ways to split a name, the cheapest of them."""
    total = sum(counts.values())

    def best(name):
        ways = {"": (0.0, [])}
        for end in range(1, len(name) + 1):
            ways[name[:end]] = min((ways[name[:i]][0] + (-math.log(counts[name[i:end]] / total) if name[i:end] in counts else math.log(10 * total) + 3.0 * (end - i)), ways[name[:i]][1] + [name[i:end]]) for i in range(end))
        return ways[name][1]

    out = []
    for kind, text in (("h", host), ("p", path.lower())):
        for part in re.findall("[a-z]+|[0-9]+", text):
            out += [f"{kind}:{'#' * len(part)}"] if part.isdigit() else [f"{kind}:{w}" for w in best(part)]
    return out


def test_odds_match_brute_force(spark):
    """Viterbi, counts, smoothing and prior, worked out anew."""
    pages = table(spark).where("page_id IS NOT NULL")
    counts = collections.Counter(w for r in pages.collect() for w in re.findall("[a-z]+", r["html"] or ""))
    counts["p"] = counts.pop("p")  # of the tags
    seen = {"block": collections.Counter(), "allow": collections.Counter()}
    times = collections.Counter()
    for r in pages.collect():
        host, path = split(r["url"])
        if verdict := brute_rule(host, path)[1]:
            times[verdict] += 1
            seen[verdict].update(brute_tokens(host, path, counts))
    every = set(seen["block"]) | set(seen["allow"])
    odds = lambda v, t: math.log((seen[v][t] + 1) / (sum(seen[v].values()) + len(every)))
    for r in url_verdicts(pages, fit_url_model(pages)).collect():
        own = [t for t in brute_tokens(r["host"], r["path"], counts) if t in every]
        want = math.log((times["block"] + 1) / (times["allow"] + 1)) + sum(odds("block", t) - odds("allow", t) for t in own)
        assert abs(r["block_odds"] - want) < 1e-9


def test_rules_of_equal_length(spark):
    from pyspark.sql import functions as F

    from folioscope.llm.urlfilter import rule_of

    df = spark.range(1)
    for rules in ([("a.b", "/c", "allow"), ("a.b", "/c", "block")], [("a.b", "/c", "block"), ("a.b", "/c", "allow")]):
        assert df.select(rule_of(F.lit("a.b"), F.lit("/c"), rules)["verdict"]).first()[0] == rules[0][2]


def test_segmentation():
    s = Segmenter.of({"casino": 5, "win": 9, "in": 40, "quiet": 3, "house": 7, "a": 50})
    assert s.split("casinowin") == ["casino", "win"] and s.split("quiethouse") == ["quiet", "house"]
    assert "".join(s.split("qqzzcasino")) == "qqzzcasino" and s.split("") == []
    assert s.tokens("a1.win", "/in/2024") == ["h:a", "h:#", "h:win", "p:in", "p:####"]


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_verdicts(pages, fit_url_model(pages)).count() == 0


def test_all_words_and_tokens_count(spark):
    """50,400 equally frequent words and tokens: each of them is known and in the totals."""
    name = lambda i: "".join("abcdefghijklmnopqrstuvwxyz"[i // 26**k % 26] for k in range(4)) + "qx"
    n = 50_400
    rows = [(i, f"http://{name(i)}.example.org/es/", name(i)) for i in range(n)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    model = fit_url_model(pages)
    assert model.total == model.words.count() == n
    tokens = {r["token"]: r["weight"] for r in model.weights.collect()}
    assert all(f"h:{name(i)}" in tokens for i in range(n))
    assert {r["block_odds"] > model.prior for r in url_verdicts(pages, model).collect()} == {True}


def test_long_names_and_words(spark, monkeypatch):
    """Names over several blocks and words longer than a seed are split as by brute force."""
    from folioscope.llm import urlfilter

    monkeypatch.setattr(urlfilter, "BLOCK_LETTERS", 8)
    monkeypatch.setattr(urlfilter, "SEED", 5)
    html = "quiet house casino winner winnertakesall winnertakesnothing houseofcards a ab abc"
    paths = ["quiethousecasinowinner", "winnertakesallwinnertakesnothing", "xxwinnertakesnothingyyhouseofcardszzabcab", "winnertakesal", "q" * 40 + "winnertakesall"]
    pages = spark.createDataFrame([(i, f"http://example.org/es/{p}", html) for i, p in enumerate(paths)], "page_id long, url string, html string")
    counts = collections.Counter(html.split() * len(paths))
    words = spark.createDataFrame(list(counts.items()), "word string, times long")
    names = spark.createDataFrame([(p,) for p in paths], "name string")
    got = {r["name"]: r["words"] for r in urlfilter.split_names(names, words, sum(counts.values())).collect()}
    for p in paths:
        assert [f"p:{w}" for w in got[p]] == brute_tokens("", p, counts)
    assert url_verdicts(pages, fit_url_model(pages)).count() == len(paths)


def test_a_url_of_a_million_letters(spark):
    """It takes seconds: rows hold blocks of it."""
    import time

    word = "quiethousecasinowin"
    pages = table(spark).unionByName(spark.createDataFrame([(99, "http://example.net/" + word * 55_000, "x", "own", "own")], table(spark).schema))
    began = time.time()
    got = {r["page_id"]: r for r in url_verdicts(pages, fit_url_model(pages)).collect()}
    assert len(got[99]["path"]) == 1 + 55_000 * len(word) and time.time() - began < 120
