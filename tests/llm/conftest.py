import pytest

CLASHING = ["row", "body", "rest", "id", "key", "mark", "size", "score", "hit", "cut", "copy", "told", "text_", "place", "source_size", "component"]


@pytest.fixture(scope="session")
def documents(spark):
    """Builds documents from (doc_id, text[, lang[, source]]) with extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    def build(rows, clashing=True):
        full = [(*r, *(None, None)[len(r) - 2 :], len(r[1]) if r[1] is not None else None) if len(r) < 4 else (*r, len(r[1] or "")) for r in rows]
        out = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        return out.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHING)) if clashing else out

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids and texts, empty, blank, repeated and very long texts, and several texts of one id."""
    prose = "The quick brown fox jumps over the lazy dog, and then it sleeps for a very long while in the warm sun near the old barn. "
    return [
        (1, prose * 2, "en", "a"),
        (1, prose * 2, "en", "a"),
        (2, prose + "Something else entirely is written here to make a difference.", "en", None),
        (3, None, "en", "a"),
        (4, "", None, "b"),
        (5, " \n\t ", None, "b"),
        (6, "é" * 150 + " ünïcödé 東京 " + "é" * 150, "fr", "c"),
        (7, "word " * 60_000, "en", "c"),
        (8, "7 + 5 = 12", "de", "c"),
        (None, prose, "en", "a"),
        (None, "another text without an id", "en", "a"),
        (9, "one text of nine", "de", "a"),
        (9, "another text of nine, somewhat longer than the first", "de", "a"),
        (10, prose * 2, "en", "a"),
    ]
