"""Tables of documents: headers, representations for retrieval, choice of a table, columns, rows, continuations."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import clean, first_number, let, number_range
from folioscope.operators.lookup import SUFFIXES, condition_matches, row_chunks

LOOKUP_TABLE = "struct<context:string,headers:array<string>,rows:array<array<string>>>"
# Columns that name a dimension, hints at a column by its symbol, and points of a table's fit.
DIMENSIONS = ("航速", "水深", "波长", "周期", "吃水", "dwt")
COLUMN_HINT = r"[Z-z]\d*|下沉|富裕|吃水"
EXACT, IN_RANGE, WITHIN = 300, 280, 220
NEAR = ((1, 50), (1000, 35), (10000, 20))
SHIPS = (("干散货船", "散货船"), ("液体散货船", "散货船"), ("货物滚装船", "滚装船"))


# ---------------------------------------------------------------- reading


class _Grid(HTMLParser):
    """Cells of the first table with their tags, spans and section, and the text before the table."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, list[dict]]] = []
        self.cell: dict | None = None
        self.section, self.done, self.inside = "", False, False
        self.heading, self.loose, self.open = "", [], None

    def handle_starttag(self, tag, attrs):
        if self.done:
            return
        spans = {k: int(v) for k, v in attrs if k in ("rowspan", "colspan") and (v or "").isdigit()}
        if tag == "table":
            self.inside = True
        elif self.inside and tag in ("thead", "tbody"):
            self.section = tag
        elif self.inside and tag == "tr":
            self.rows.append((self.section, []))
        elif self.inside and tag in ("td", "th"):
            self.cell = {"tag": tag, "text": [], **spans}
        elif tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.open = []

    def handle_endtag(self, tag):
        if self.done:
            return
        if tag == "table":
            self.done = self.inside
        elif tag in ("td", "th") and self.cell is not None:
            self.cell["text"] = "".join(self.cell["text"]).strip()
            if not self.rows:
                self.rows.append((self.section, []))
            self.rows[-1][1].append(self.cell)
            self.cell = None
        elif tag in ("thead", "tbody"):
            self.section = ""
        elif self.open is not None and tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.heading, self.open = "".join(self.open).strip(), None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell["text"].append(data.strip() and data)
        elif not self.inside:
            (self.loose if self.open is None else self.open).append(data)


def _header_rows(rows: list[list[dict]]) -> int:
    """Two where the first row spans cells or the second has header cells, else one."""
    if len(rows) < 2:
        return len(rows)
    spanned = any(cell.get(span, 1) > 1 for cell in rows[0] for span in ("rowspan", "colspan"))
    return 2 if spanned or any(cell["tag"] == "th" for cell in rows[1]) else 1


def _two_row_header(upper: list[dict], lower: list[dict]) -> list[str]:
    """Cells that span both rows stay; each other gives way to the next of the second row, whose rest follows."""
    below = iter([c["text"] for c in lower])
    named = [c["text"] if c.get("rowspan", 1) > 1 else next(below, None) for c in upper]
    return [n for n in named if n is not None] + list(below)


def _lookup_table(html: str | None) -> dict | None:
    if not html:
        return None
    grid = _Grid()
    grid.feed(html)
    rows = [cells for _, cells in grid.rows]
    head = [c["text"] for section, cells in grid.rows if section == "thead" for c in cells]
    body = [cells for section, cells in grid.rows if section == "tbody"] or None
    n = _header_rows(rows)
    if not head and rows:
        head = _two_row_header(rows[0], rows[1]) if n == 2 else [c["text"] for c in rows[0]]
    texts = [[c["text"] for c in cells] for cells in (body if body is not None else rows[n:])]
    before = [x.strip() for x in "".join(grid.loose).splitlines() if x.strip()]
    return {"context": grid.heading or (before[-1] if before else ""), "headers": head, "rows": [t for t in texts if t]}


def lookup_tables(html: Column) -> Column:
    """The first table of an HTML text for lookups: struct of context (the heading, paragraph or line before it), headers
    (those of the head, else of one row, or of two merged ones) and rows; spans of the body count for nothing."""

    def parse(texts: pd.Series) -> pd.DataFrame:
        found = [_lookup_table(t) or {"context": None, "headers": None, "rows": None} for t in texts]
        return pd.DataFrame(found, columns=["context", "headers", "rows"])

    return F.pandas_udf(parse, LOOKUP_TABLE)(html)


def _table_rows(html: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<tr\b.*?</tr>"), F.lit(0))


def _row_form(row: Column) -> Column:
    """A row by its texts alone."""
    cells = F.regexp_extract_all(row, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1))
    return F.transform(cells, lambda c: F.regexp_replace(c, r"<[^>]+>|\s+", ""))


def joined_html(head: Column, tail: Column) -> Column:
    """A table continued by another, without the header rows that the second repeats."""
    first, second = _table_rows(head), _table_rows(tail)
    repeats = F.zip_with(F.transform(second, _row_form), F.transform(first, _row_form), lambda a, b: ~a.eqNullSafe(b))
    drop = F.coalesce(F.nullif(F.array_position(repeats, True), F.lit(0)) - 1, F.size(second)).cast("int")
    more = F.array_join(F.slice(second, drop + 1, F.greatest(F.size(second) - drop, F.lit(0))), "")
    end = F.regexp_extract(head, r"(?is)^.*(</table>.*)$", 1)
    whole = F.concat(F.substr(head, F.lit(1), F.char_length(head) - F.char_length(end)), more, end)
    return F.when((F.size(first) == 0) | (F.size(second) == 0), F.coalesce(F.nullif(head, F.lit("")), tail)).otherwise(whole)


# ---------------------------------------------------------------- representations


def represented(title: Column, headers: Column, rows: Column, kind: Column) -> Column:
    """What retrieval knows of a table: struct of schema (header cells), row_keys (first cells), summary, and chunks (a text
    per row, for tables of words)."""
    plain = F.filter(F.transform(headers, clean), lambda c: c != "")
    keys = F.filter(F.transform(F.filter(rows, lambda r: F.size(r) > 0), lambda r: clean(F.get(r, F.lit(0)))), lambda k: k != "")
    width = F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))
    named = F.coalesce(F.nullif(title, F.lit("")), F.lit("未命名表格"))
    summary = F.concat(F.lit("表格《"), named, F.lit("》包含 "), F.size(rows), F.lit(" 行、"), width, F.lit(" 列。"))
    words = F.when(kind != "numeric_dense", row_chunks(title, plain, rows)).otherwise(F.array().cast("array<string>"))
    return F.struct(plain.alias("schema"), keys.alias("row_keys"), summary.alias("summary"), words.alias("chunks"))


def table_chunks(tables: DataFrame) -> DataFrame:
    """(chunk_id, table_id, chunk_type, text) of tables (table_id, table_type, shown: represented): the summary, and a chunk per row."""
    kind = F.when(F.col("table_type") == "mapping_enum", "table_mapping_row").otherwise("table_text_row")
    rows = tables.select("table_id", kind.alias("chunk_type"), F.posexplode("shown.chunks").alias("n", "text"))
    rows = rows.select(F.concat_ws(":", "table_id", F.lit("row"), "n").alias("chunk_id"), "table_id", "chunk_type", "text")
    heads = tables.select(F.concat_ws(":", "table_id", F.lit("summary")).alias("chunk_id"), "table_id", F.lit("table_summary").alias("chunk_type"), F.col("shown.summary").alias("text"))
    return heads.unionByName(rows)


# ---------------------------------------------------------------- which table


def reference_form(text: Column) -> Column:
    """A table's number without blanks, in lower case, with plain dashes."""
    return F.translate(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")), "～—–", "~--")


def table_references(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)(?:表|图)\s*[A-Za-z0-9.]+(?:-\d+)?"), F.lit(0))
    return F.transform(found, reference_form)


def reference_range(asked: str) -> tuple[str, int, int] | None:
    """What `表A-1~表A-14` covers: the common part, the first and the last number."""
    found = re.search(r"((?:表|图)[A-Za-z0-9.]+)-(\d+)~\1-(\d+)", asked.strip())
    span = found and (found[1], int(found[2]), int(found[3]))
    return span if span and span[1] < span[2] else None


def in_range(caption: Column, asked: str) -> Column:
    """The number of a caption within the asked range, else null."""
    span = reference_range(asked)
    if span is None:
        return F.lit(None).cast("int")
    number = F.nullif(F.regexp_extract(caption, rf"\Q{span[0]}\E-(\d+)", 1), F.lit("")).cast("int")
    return F.when(number.between(span[1], span[2]), number)


def reference_score(asked: str, context: Column) -> Column:
    """How well the text around a table fits the asked number: the very number, one in the range, or the number within the text."""
    form = re.sub(r"\s+", "", asked).lower().translate(str.maketrans("～—–", "~--"))
    refs, score = table_references(context), F.lit(0)
    if form:
        score = F.when(F.contains(reference_form(context), F.lit(form)), WITHIN).otherwise(0)
    span = reference_range(asked)
    if span is not None:
        number = lambda r: F.nullif(F.regexp_extract(r, rf"\Q{span[0].lower()}\E-(\d+)", 1), F.lit("")).cast("int")
        score = F.when(F.exists(refs, lambda r: F.coalesce(number(r).between(span[1], span[2]), F.lit(False))), IN_RANGE).otherwise(score)
    return F.when(F.array_contains(refs, form), EXACT).otherwise(score)


def numeric_fit(cells: Column, value: Column) -> Column:
    """How well a column of numbers or ranges suits a value: 60 within a range, less the farther the nearest is, 5 at least; 0 without numbers."""

    def distance(cell: Column) -> Column:
        """0 within a range, which is told by a distance of -1, else what lies between."""
        span, number = number_range(cell), first_number(cell)
        low, high = F.coalesce(span["lo"], F.lit(float("-inf"))), F.coalesce(span["hi"], F.lit(float("inf")))
        return F.when(span.isNotNull(), F.when(value.between(low, high), -1.0).otherwise(F.least(F.abs(value - low), F.abs(value - high)))).otherwise(F.abs(number - value))

    def points(closest: Column) -> Column:
        out = F.when(closest.isNull(), 0).when(closest < 0, 60)
        for most, p in NEAR:
            out = out.when(closest <= most, p)
        return out.otherwise(5)

    return let(F.array_min(F.transform(cells, distance)), points)


def chosen_table(tables: DataFrame, asked: str, conditions: Mapping[str, str], *, fit: Column | None = None) -> DataFrame:
    """The table (table_id, context, headers, ...) that suits a name and conditions best: by its number, 50 for the name in its
    context, 12 for each condition that a header has, and how well its numbers fit; of equally good ones the first id."""
    form = "".join(asked.split()).lower()
    score = reference_score(asked, F.col("context")) + F.when(F.contains(reference_form(F.col("context")), F.lit(form)) & F.lit(bool(form)), 50).otherwise(0)
    for key in conditions:
        score = score + F.when(column_index(F.col("headers"), key).isNotNull(), 12).otherwise(0)
    rows = tables.withColumn("fit_score", score + (F.lit(0) if fit is None else fit))
    return rows.orderBy(F.desc("fit_score"), "table_id").limit(1)


# ---------------------------------------------------------------- columns and rows


def variants(name: str) -> list[str]:
    """Forms of a name in which it may be found: without joining words, without words that carry nothing, ships by their class."""
    base = "".join(name.split()).lower()
    forms = [base, re.sub("[或和及的]", "", base), *(base.replace(s, "") for s in SUFFIXES), *(base.replace(*pair) for pair in SHIPS)]
    if base.endswith("船"):
        forms.append(base[:-1])
    return [f for f in dict.fromkeys(forms) if f]


def column_index(headers: Column, key: str, synonyms: Sequence[str] = ()) -> Column:
    """Place of the first header that a name or a synonym fits, one within the other; null without one.

    Columns that are named by a dimension are left out, unless a number follows it. Where nothing fits, symbols in the name do.
    """
    form = lambda h: F.lower(F.regexp_replace(h, r"\s+", ""))

    def first(fits) -> Column:
        places = F.transform(headers, lambda h, i: F.when(fits(h), i))
        return F.array_min(F.array_compact(places))

    def named(candidate: str):
        def fits(h: Column) -> Column:
            dimension = reduce(lambda a, b: a | b, (F.contains(form(h), F.lit(d)) for d in DIMENSIONS)) & ~h.rlike(r"\d")
            hits = [F.contains(form(h), F.lit(v)) | F.contains(F.lit(v), form(h)) for v in variants(candidate)]
            return ~dimension & reduce(lambda a, b: a | b, hits, F.lit(False))

        return fits

    def hinted(h: Column) -> Column:
        hits = [F.contains(form(h), F.lit(p.lower())) | F.contains(F.lit(p.lower()), form(h)) for p in re.findall(COLUMN_HINT, key)]
        return reduce(lambda a, b: a | b, hits, F.lit(False))

    return F.coalesce(*(first(named(c)) for c in (key, *synonyms)), first(hinted))


def looked_up(rows: DataFrame, headers: Sequence[str], conditions: Mapping[str, str], target: str | None = None) -> DataFrame:
    """The row (row_index, cells) of a table that fits conditions best, with its distance and the value of the target column.

    Conditions in words leave the rows of which their column, or any where no header fits, suits; if none
    is left, all count. Conditions with a number then take the nearest row: 0 within a range, else the
    difference to it.
    """
    place = {k: next((i for i, h in enumerate(headers) if _fits(h, k)), None) for k in [*conditions, *([target] if target else [])]}
    numbers = {k: float(m[0]) for k, v in conditions.items() if (m := re.search(r"-?\d+(?:\.\d+)?", str(v)))}
    words = {k: v for k, v in conditions.items() if k not in numbers}
    cell = lambda k: F.get("cells", F.lit(place[k])) if place[k] is not None else F.array_join("cells", " ")
    out = rows
    if words:
        suits = reduce(lambda a, b: a & b, (condition_matches(cell(k), str(v)) for k, v in words.items()))
        marked = rows.withColumn("_suits", suits)
        some = marked.agg(F.coalesce(F.max("_suits"), F.lit(False)).alias("_some"))  # one row
        out = marked.join(F.broadcast(some)).where(F.col("_suits") | ~F.col("_some")).drop("_suits", "_some")

    def distance(k: str, value: float) -> Column:
        span, number = number_range(cell(k)), first_number(cell(k))
        low, high = F.coalesce(span["lo"], F.lit(float("-inf"))), F.coalesce(span["hi"], F.lit(float("inf")))
        outside = F.least(F.abs(low - value), F.abs(high - value))
        return F.when(span.isNotNull(), F.when(F.lit(value).between(low, high), 0.0).otherwise(outside)).otherwise(F.abs(number - value))

    total = reduce(lambda a, b: a + b, (distance(k, v) for k, v in numbers.items()), F.lit(0.0))
    value = F.get("cells", F.lit(place[target])) if target and place[target] is not None else F.lit(None).cast("string")
    return out.withColumn("distance", total).where("distance IS NOT NULL").orderBy("distance", "row_index").limit(1).withColumn("value", value)


def _fits(header: str, key: str) -> bool:
    own = "".join(header.split()).lower()
    if any(d in own for d in DIMENSIONS) and not re.search(r"\d", header):
        return False
    return any(v in own or own in v for v in variants(key))


# ---------------------------------------------------------------- across pages


def continued(tables: DataFrame, titles: DataFrame, *, evidence: int = 2) -> DataFrame:
    """(doc_id, source_id, target_id): the last table of a page and the first of the next that continue each other.

    tables: doc_id, table_id, page_idx, seq, number (of the caption, or null), columns, width, header
    (array of header texts), marked (whether a word before it says so); titles: doc_id, page_idx, seq. No title
    stands between, numbers don't differ, and of a mark, equal headers, as many columns and a width within 5%
    enough hold.
    """
    edge = tables.groupBy("doc_id", "page_idx").agg(F.max_by(F.struct(*tables.columns), F.struct("seq", "table_id")).alias("last"), F.min_by(F.struct(*tables.columns), F.struct("seq", "table_id")).alias("first"))
    after = edge.select("doc_id", (F.col("page_idx") - 1).alias("page_idx"), F.col("first").alias("next"))
    pairs = edge.join(after, ["doc_id", "page_idx"]).select("doc_id", "page_idx", "last", "next")
    signs = [F.col("next.marked"), (F.size("last.header") > 0) & (F.col("last.header") == F.col("next.header")), (F.col("last.columns") > 0) & (F.col("last.columns") == F.col("next.columns")), F.abs(F.col("last.width") - F.col("next.width")) <= 0.05 * F.greatest("last.width", "next.width")]
    enough = reduce(lambda a, b: a + b, (F.coalesce(s, F.lit(False)).cast("int") for s in signs)) >= evidence
    same = F.coalesce(F.col("last.number") == F.col("next.number"), F.lit(True))
    # Titles after the table on its page, or before the next one on that page: each page's first and last say so.
    own = titles.groupBy("doc_id", "page_idx").agg(F.max("seq").alias("last_title"), F.min("seq").alias("first_title"))
    here, there = own.select("doc_id", "page_idx", "last_title"), own.select("doc_id", (F.col("page_idx") - 1).alias("page_idx"), "first_title")
    pairs = pairs.join(here, ["doc_id", "page_idx"], "left").join(there, ["doc_id", "page_idx"], "left")
    between = F.coalesce(F.col("last_title") > F.col("last.seq"), F.lit(False)) | F.coalesce(F.col("first_title") < F.col("next.seq"), F.lit(False))
    return pairs.where(enough & same & ~between).select("doc_id", F.col("last.table_id").alias("source_id"), F.col("next.table_id").alias("target_id"))


def attachments(merged: DataFrame, blocks: DataFrame, *, most: int = 40, top: float = 0.25) -> DataFrame:
    """(table_id, block_id): blocks at the head of a continued table's further pages that repeat its number; they belong to its caption.

    merged: table_id, doc_id, page_idx (of a further page), number; blocks: doc_id, page_idx, block_id, block_type, layout_category, text, y0.
    """
    short = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", "")
    fits = F.col("block_type").isin("paragraph", "text", "list", "list_item", "title", "page_header", "header") & ~F.coalesce("layout_category", F.lit("")).isin("furniture", "attachment")
    rows = blocks.where(fits & F.char_length(short).between(2, most) & (F.coalesce("y0", F.lit(1.0)) <= top)).select("doc_id", "page_idx", "block_id", short.alias("short"))
    return merged.join(rows, ["doc_id", "page_idx"]).where(F.contains("short", F.col("number"))).select("table_id", "block_id").distinct()


def caption_order(media: DataFrame, captions: DataFrame) -> DataFrame:
    """(doc_id, page_idx, media_id, caption_id): the k-th caption of a page with its k-th figure or table, from top to bottom."""
    order = Window.partitionBy("doc_id", "page_idx").orderBy("y0", "id")
    a = media.withColumn("k", F.row_number().over(order)).select("doc_id", "page_idx", "k", F.col("id").alias("media_id"))
    b = captions.withColumn("k", F.row_number().over(order)).select("doc_id", "page_idx", "k", F.col("id").alias("caption_id"))
    return a.join(b, ["doc_id", "page_idx", "k"]).drop("k")
