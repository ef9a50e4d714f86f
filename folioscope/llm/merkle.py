"""Document fingerprints: Merkle trees over sections, paragraphs and clauses, in DataFrame operations only.

Sections are parted by blank lines, paragraphs by line ends, and the leaves of a paragraph are its
clauses, each with the punctuation and the blank that end it. Leaves and shape give the text back, and digests are those of SHA-256 (128
bits of it within the tree), so equal roots mean equal texts; where roots differ, only branches with differing digests hold edits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import materialize
from folioscope.llm.mixing import numbered

#: What ends a clause; group 1 stays with the clause.
CLAUSE_END = "([.,;:!?*%$#&] )"
#: Hexadecimal digits of a leaf's digest that a fingerprint shows, and leaves that it shows at most: those of the smallest digests.
SHOWN, KEPT = 8, 128


def digest(text: Column) -> Column:
    """The digest of a node: the first 128 bits of SHA-256, in hexadecimal."""
    return F.substring(F.sha2(text, 256), 1, 32)


def merkle_leaves(text: Column) -> Column:
    """Leaf digests as array (sections) of array (paragraphs) of array (clauses); a null text is empty."""
    sections = F.split(F.coalesce(text, F.lit("")), "\n\n")
    return F.transform(
        sections,
        lambda section: F.transform(F.split(section, "\n"), lambda paragraph: F.transform(F.split(F.regexp_replace(paragraph, CLAUSE_END, "$1\u0001"), "\u0001"), digest)),
    )


def paragraph_digests(leaves: Column) -> Column:
    """Digests of the paragraphs, by section."""
    return F.transform(leaves, lambda section: F.transform(section, lambda paragraph: digest(F.array_join(paragraph, ""))))


def section_digests(leaves: Column) -> Column:
    return F.transform(paragraph_digests(leaves), lambda section: digest(F.array_join(section, "")))


def root(leaves: Column) -> Column:
    return F.sha2(F.array_join(section_digests(leaves), ""), 256)


def fingerprint(leaves: Column) -> Column:
    """Root, colon, then the smallest KEPT distinct heads of the leaf digests, in order: at most 1,089 characters, however long the text."""
    heads = F.array_distinct(F.flatten(F.transform(leaves, lambda s: F.flatten(F.transform(s, lambda p: F.transform(p, lambda leaf: F.substring(leaf, 1, SHOWN)))))))
    return F.concat(root(leaves), F.lit(":"), F.array_join(F.slice(F.array_sort(heads), 1, KEPT), ""))


def shown_leaves(print_: Column) -> Column:
    """Leaf heads of a fingerprint."""
    return F.regexp_extract_all(F.substring_index(print_, ":", -1), F.lit(f"[0-9a-f]{{{SHOWN}}}"), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of the distinct leaves of two fingerprints: 1 if equal, 0 if they share no clause. Exact where both texts have
    fewer than KEPT leaves; beyond, the smallest KEPT of both together are a sample of all, drawn by their digests."""

    def dice(x: Column) -> Column:
        every = F.array_sort(F.array_union(x["left"], x["right"]))
        some = F.when(F.greatest(F.size(x["left"]), F.size(x["right"])) < KEPT, every).otherwise(F.slice(every, 1, KEPT))
        return _let(some, lambda u: _let(F.size(F.array_intersect(F.array_intersect(u, x["left"]), x["right"])), lambda both: 2.0 * both / (F.size(u) + both)))

    return F.when(a == b, F.lit(1.0)).otherwise(_let(F.struct(shown_leaves(a).alias("left"), shown_leaves(b).alias("right")), dice))


def _let(value: Column, build: Callable[[Column], Column]) -> Column:
    """build(value) with the value worked out once."""
    return F.element_at(F.transform(F.array(value), build), 1)


def _differing(old: Column, new: Column) -> Column:
    """Struct (head, tail, most) of two digest lists: how many they share at their beginning, at their end without
    those, and the longer length."""
    unequal = F.zip_with(old, new, lambda x, y: ~x.eqNullSafe(y))
    turned = F.zip_with(F.reverse(old), F.reverse(new), lambda x, y: ~x.eqNullSafe(y))

    def build(sizes: Column) -> Column:
        first = F.coalesce(F.nullif(F.array_position(unequal, True), F.lit(0)) - 1, sizes["most"]).cast("int")
        last = F.coalesce(F.nullif(F.array_position(turned, True), F.lit(0)) - 1, sizes["most"]).cast("int")
        return F.struct(first.alias("head"), F.least(last, sizes["least"] - first).alias("tail"), sizes["most"].alias("most"))

    return _let(F.struct(F.greatest(F.size(old), F.size(new)).alias("most"), F.least(F.size(old), F.size(new)).alias("least")), build)


def _middle(part: Column) -> Column:
    """Positions that differ: after the shared beginning and before the shared end."""
    return F.when(part["head"] < part["most"] - part["tail"], F.sequence(part["head"], part["most"] - part["tail"] - 1)).otherwise(F.array().cast("array<int>"))


def edited_paragraphs(before: Column, after: Column) -> Column:
    """Where two leaf arrays differ: (section, paragraph) positions, from 0.

    Goes down the trees: sections that both texts share at their beginning and end are left out by their
    digests, then, in each section that differs, the paragraphs that are shared so. What is left is compared in
    place. Where one text has more sections or paragraphs, positions count those of the longer one.
    """
    empty = F.array().cast("array<string>")

    def branches(trees: Column, sections: Column, i: Column) -> Column:
        """The paragraphs of a section in both texts; those of the shared end belong to no section that differs."""
        old, new = (F.when(i < F.size(trees[x]) - sections["tail"], F.get(trees[x], i)).otherwise(empty) for x in ("old", "new"))
        return F.struct(old.alias("old"), new.alias("new"))

    def places(i: Column, pair: Column, part: Column) -> Column:
        own = lambda x, p: F.when(p < F.size(pair[x]) - part["tail"], F.get(pair[x], p))
        differing = F.filter(_middle(part), lambda p: ~own("old", p).eqNullSafe(own("new", p)))
        return F.transform(differing, lambda p: F.struct(i.alias("section"), p.alias("paragraph")))

    def sections(trees: Column) -> Column:
        within = lambda part: F.transform(_middle(part), lambda i: _let(branches(trees, part, i), lambda pair: _let(_differing(pair["old"], pair["new"]), lambda inner: places(i, pair, inner))))
        digests = [F.transform(trees[x], lambda section: digest(F.array_join(section, ""))) for x in ("old", "new")]
        return F.flatten(_let(_differing(*digests), within))

    return _let(F.struct(paragraph_digests(before).alias("old"), paragraph_digests(after).alias("new")), sections)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of an edited text: its last floor(n_chars / 4) code points replaced by the first
    as many (or all) of the next document's, in ascending doc_id, after the last the first.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and
    edited_at, the positions of the edit as `section:paragraph`, comma-joined. Null texts are empty. A null
    doc_id comes first; different texts of one id come in order of their hashes; repeated rows are one
    document and get equal results; a single document is its own next. The tree of a text is held in its
    row while it is worked on: some ten times its bytes. Only doc_id and text are read.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    doc, none = F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").isNull()
    key = ["doc", "none", "mark"]
    # Both uses of the texts need the same columns, so that they are shuffled once.
    texts = docs.select(body.alias("body"), doc.alias("doc"), none.alias("none"), F.xxhash64(body).alias("mark")).repartition(*key)
    slim = docs.select(doc.alias("doc"), none.alias("none"), F.xxhash64(body).alias("mark"), F.char_length(body).alias("n")).distinct()
    ring = materialize(numbered(slim, F.desc("none"), F.col("doc"), F.col("mark")))
    n = ring.count()
    # Each document as the next one of another: whose, and how much of it that one takes.
    asked = ring.select(*(F.col(k).alias(f"of_{k}") for k in key), F.floor(F.col("n") / 4).cast("int").alias("take"), ((F.col("number") + 1) % max(n, 1)).alias("number"))
    asked = ring.select(*key, "number").join(asked, "number").drop("number")
    given = texts.join(asked, key).select("body", *(f"of_{k}" for k in key), "take", merkle_leaves(F.col("body")).alias("leaves"))
    given = given.select(*(F.col(f"of_{k}").alias(k) for k in key), "take", F.expr("substring(body, 1, take)").alias("head"), fingerprint(F.col("leaves")).alias("next_fingerprint"))
    given = given.dropDuplicates(key)  # repeated rows of the next document

    both = texts.join(given, key)
    doc_id = F.when(~F.col("none"), F.col("doc")).cast(docs.schema["doc_id"].dataType)
    both = both.select(doc_id.alias("doc_id"), "body", "next_fingerprint", F.char_length("body").cast("long").alias("n_chars"), F.expr("concat(substring(body, 1, char_length(body) - take), head)").alias("edited"))
    both = both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "next_fingerprint", merkle_leaves(F.col("body")).alias("leaves"), merkle_leaves(F.col("edited")).alias("edited_leaves"))
    both = both.select("doc_id", "n_chars", "edited_sha256", "next_fingerprint", fingerprint(F.col("leaves")).alias("fingerprint"), fingerprint(F.col("edited_leaves")).alias("edited_fingerprint"), edited_paragraphs(F.col("leaves"), F.col("edited_leaves")).alias("edited_at"))
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        F.array_join(F.transform("edited_at", lambda x: F.concat_ws(":", x["section"], x["paragraph"])), ",").alias("edited_at"),
    )
