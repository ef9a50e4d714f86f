"""One registered query per operator, over its whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import is_held_out, read_table
from folioscope.llm.convtrie import trie
from folioscope.llm.decontaminate import contamination_report
from folioscope.llm.filteraudit import filter_audit
from folioscope.llm.jaccard_join import jaccard_groups
from folioscope.llm.language import fit_language_model, predict_language
from folioscope.llm.merkle import fingerprints
from folioscope.llm.mixing import mix_report
from folioscope.llm.quality import fit_quality, quality_scores
from folioscope.llm.qualityrules import rule_report
from folioscope.llm.suffix_dedup import repeat_report
from folioscope.llm.toolcalls import REPLY, conversation_calls, link_calls, other_messages
from folioscope.llm.urlfilter import fit_url_model, url_verdicts
from folioscope.llm.warc import round_trip


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "pages"))


def op2_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents"))


def op3_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = read_table(spark, sf_dir, "conversations")
    calls, results = conversation_calls(messages)
    return link_calls(calls, results, REPLY).unionByName(other_messages(messages))


def op3_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of op3_toolcalls that are neither calls nor results, alone."""
    return other_messages(read_table(spark, sf_dir, "conversations"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(read_table(spark, sf_dir, "documents"))


def op5_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return url_verdicts(pages, fit_url_model(pages))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(read_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels")
    held_out = is_held_out(F.col("doc_id"))
    model = fit_quality(docs.where(~held_out), labels.where(~held_out))
    return quality_scores(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language_model(docs.where(~is_held_out(F.col("doc_id"))))
    predicted = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), predict_language(docs, model).alias("p"))
    return predicted.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(read_table(spark, sf_dir, "documents"))


def op11_convtrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(read_table(spark, sf_dir, "conversations"))


def op12_qualityrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_filteraudit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_merkle": op2_merkle,
    "op3_toolcalls": op3_toolcalls,
    "op3_messages": op3_messages,
    "op4_mixing": op4_mixing,
    "op5_urlfilter": op5_urlfilter,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_quality": op7_quality,
    "op8_language": op8_language,
    "op9_decontaminate": op9_decontaminate,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_convtrie": op11_convtrie,
    "op12_qualityrules": op12_qualityrules,
    "op13_filteraudit": op13_filteraudit,
}

#: crc32 of the decimal doc_id, byte by byte and bit by bit.
CRC32_OF_ID = """xor(list_reduce(list_prepend(4294967295, [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]),
                   lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

ORACLE_SQL: dict[str, str] = {
    "op1_warc": r"""
        WITH hashed AS (
            SELECT page_id, url, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
        digests AS (
            SELECT page_id, url, octet_length(encode(body)) AS payload_bytes,
                   array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, 5 * (k // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31) + 1, 1) for k in range(32)], '') AS payload_digest
            FROM hashed),
        firsts AS (SELECT payload_digest, min(page_id) AS first FROM digests GROUP BY payload_digest)
        SELECT page_id, url, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
        FROM digests JOIN firsts USING (payload_digest)""",
    "op2_merkle": r"""
        WITH ring AS (
            SELECT DISTINCT doc_id, coalesce(text, '') AS body FROM documents),
        chained AS (
            SELECT doc_id, body, coalesce(lead(body) OVER (ORDER BY doc_id NULLS FIRST), first_value(body) OVER (ORDER BY doc_id NULLS FIRST)) AS next_body FROM ring),
        edited AS (
            SELECT doc_id, body, next_body, left(body, length(body) - length(body) // 4) || left(next_body, length(body) // 4) AS edited FROM chained),
        texts AS (
            SELECT body AS t FROM edited UNION SELECT edited FROM edited),
        leaves AS (
            SELECT t, [[[left(sha256(l), 32) for l in string_split(regexp_replace(p, '([.,;:!?*%$#&] )', '\1' || chr(1), 'g'), chr(1))] for p in string_split(s, chr(10))] for s in string_split(t, chr(10) || chr(10))] AS tree
            FROM texts),
        prints AS (
            SELECT t, root || ':' || array_to_string(heads, '') AS print, heads
            FROM (SELECT t, sha256(array_to_string([left(sha256(array_to_string([left(sha256(array_to_string(p, '')), 32) for p in s], '')), 32) for s in tree], '')) AS root, list_sort(list_distinct([left(l, 8) for l in flatten(flatten(tree))]))[1:128] AS heads FROM leaves)),
        branches AS (SELECT t, [[left(sha256(array_to_string(p, '')), 32) for p in s] for s in tree] AS digests FROM leaves),
        changed AS (
            SELECT doc_id, body, a.digests AS old, b.digests AS new,
                   [left(sha256(array_to_string(s, '')), 32) FOR s IN a.digests] AS so, [left(sha256(array_to_string(s, '')), 32) FOR s IN b.digests] AS sn
            FROM edited JOIN branches a ON a.t = body JOIN branches b ON b.t = edited),
        section_heads AS (
            SELECT *, list_position([so[k] IS NOT DISTINCT FROM sn[k] AND k <= greatest(len(so), len(sn)) FOR k IN range(1, greatest(len(so), len(sn)) + 2)], false) - 1 AS head,
                   list_position([list_reverse(so)[k] IS NOT DISTINCT FROM list_reverse(sn)[k] AND k <= greatest(len(so), len(sn)) FOR k IN range(1, greatest(len(so), len(sn)) + 2)], false) - 1 AS tail
            FROM changed),
        sections AS (
            SELECT doc_id, body, i, CASE WHEN i < len(so) - cut THEN old[i + 1] ELSE [] END AS a, CASE WHEN i < len(sn) - cut THEN new[i + 1] ELSE [] END AS b
            FROM (SELECT *, unnest(range(head, greatest(len(so), len(sn)) - cut)) AS i FROM (SELECT *, least(tail, least(len(so), len(sn)) - head) AS cut FROM section_heads))),
        paragraph_heads AS (
            SELECT *, list_position([a[k] IS NOT DISTINCT FROM b[k] AND k <= greatest(len(a), len(b)) FOR k IN range(1, greatest(len(a), len(b)) + 2)], false) - 1 AS head,
                   list_position([list_reverse(a)[k] IS NOT DISTINCT FROM list_reverse(b)[k] AND k <= greatest(len(a), len(b)) FOR k IN range(1, greatest(len(a), len(b)) + 2)], false) - 1 AS tail
            FROM sections),
        paragraphs AS (
            SELECT doc_id, body, i, j, CASE WHEN j < len(a) - cut THEN a[j + 1] END AS x, CASE WHEN j < len(b) - cut THEN b[j + 1] END AS y
            FROM (SELECT *, unnest(range(head, greatest(len(a), len(b)) - cut)) AS j FROM (SELECT *, least(tail, least(len(a), len(b)) - head) AS cut FROM paragraph_heads))),
        places AS (
            SELECT doc_id, body, string_agg(i || ':' || j, ',' ORDER BY i, j) AS edited_at FROM paragraphs WHERE x IS DISTINCT FROM y GROUP BY doc_id, body)
        SELECT d.doc_id, CAST(length(d.body) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, a.print AS fingerprint, b.print AS edited_fingerprint,
               CASE WHEN a.print = b.print THEN 1.0 ELSE 2.0 * len(list_intersect(list_intersect((list_sort(list_distinct(list_concat(a.heads, b.heads))))[1:CASE WHEN greatest(len(a.heads), len(b.heads)) < 128 THEN 256 ELSE 128 END], a.heads), b.heads)) / (len((list_sort(list_distinct(list_concat(a.heads, b.heads))))[1:CASE WHEN greatest(len(a.heads), len(b.heads)) < 128 THEN 256 ELSE 128 END]) + len(list_intersect(list_intersect((list_sort(list_distinct(list_concat(a.heads, b.heads))))[1:CASE WHEN greatest(len(a.heads), len(b.heads)) < 128 THEN 256 ELSE 128 END], a.heads), b.heads))) END AS near_edited,
               CASE WHEN a.print = c.print THEN 1.0 ELSE 2.0 * len(list_intersect(list_intersect((list_sort(list_distinct(list_concat(a.heads, c.heads))))[1:CASE WHEN greatest(len(a.heads), len(c.heads)) < 128 THEN 256 ELSE 128 END], a.heads), c.heads)) / (len((list_sort(list_distinct(list_concat(a.heads, c.heads))))[1:CASE WHEN greatest(len(a.heads), len(c.heads)) < 128 THEN 256 ELSE 128 END]) + len(list_intersect(list_intersect((list_sort(list_distinct(list_concat(a.heads, c.heads))))[1:CASE WHEN greatest(len(a.heads), len(c.heads)) < 128 THEN 256 ELSE 128 END], a.heads), c.heads))) END AS near_next, coalesce(edited_at, '') AS edited_at
        FROM edited d JOIN prints a ON a.t = d.body JOIN prints b ON b.t = edited JOIN prints c ON c.t = next_body
             LEFT JOIN places e ON e.doc_id IS NOT DISTINCT FROM d.doc_id AND e.body = d.body""",
    "op3_toolcalls": r"""
        WITH calls AS (
            SELECT conv_id, turn, min(text) AS text, count(*) AS times FROM documents_of_users GROUP BY conv_id, turn),
        ordered AS (
            SELECT *, row_number() OVER w - 1 AS depth, lag(turn) OVER w AS before FROM calls WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        answers AS (
            SELECT conv_id, turn - 1 AS turn, min(text) AS content, count(*) AS times FROM conversations WHERE role = 'assistant' GROUP BY conv_id, turn),
        parts AS (
            SELECT coalesce(c.conv_id, a.conv_id) AS thread, coalesce(c.conv_id, a.conv_id) || ':' || coalesce(c.turn, a.turn) AS call_id, c.conv_id IS NOT NULL AS called, a.conv_id IS NOT NULL AS answered,
                   depth, c.conv_id || ':' || before AS after, text, content, c.turn AS turn, coalesce(c.times, 1) - 1 + coalesce(a.times, 1) - 1 AS repeats
            FROM ordered c FULL JOIN answers a ON a.conv_id = c.conv_id AND a.turn = c.turn)
        SELECT thread, call_id, CASE WHEN called THEN 'reply' END AS tool, depth, CASE WHEN called THEN row_number() OVER (PARTITION BY thread, called ORDER BY depth, call_id) - 1 END AS position,
               CASE WHEN NOT called THEN 'orphan' WHEN NOT answered THEN 'unanswered' ELSE 'linked' END AS status,
               CASE WHEN called AND text IS NULL THEN 'missing text' ELSE '' END AS problems, repeats,
               '{' || array_to_string([
                   CASE WHEN after IS NOT NULL THEN '"after":' || to_json(after) END,
                   CASE WHEN called THEN '"arguments":{"conversation":' || thread || CASE WHEN text IS NULL THEN '' ELSE ',"text":' || to_json(text) END || ',"turn":' || turn || '}' END,
                   '"id":' || to_json(call_id),
                   CASE WHEN called THEN '"name":"reply"' END,
                   CASE WHEN content IS NOT NULL THEN '"result":' || to_json(content) END], ',') || '}' AS record
        FROM parts""".replace("documents_of_users", "conversations WHERE role = 'user'"),
    "op3_messages": r"""
        SELECT conv_id AS thread, conv_id || ':' || turn AS call_id, CAST(NULL AS VARCHAR) AS tool, CAST(NULL AS BIGINT) AS depth, CAST(NULL AS BIGINT) AS position, 'message' AS status, '' AS problems, CAST(0 AS BIGINT) AS repeats,
               '{' || array_to_string([
                   CASE WHEN conv_id IS NOT NULL THEN '"conversation":' || conv_id END,
                   CASE WHEN role IS NOT NULL THEN '"role":' || to_json(role) END,
                   CASE WHEN text IS NOT NULL THEN '"text":' || to_json(text) END,
                   CASE WHEN turn IS NOT NULL THEN '"turn":' || turn END], ',') || '}' AS record
        FROM conversations WHERE conv_id IS NULL OR turn IS NULL OR role IS NULL OR role NOT IN ('user', 'assistant')""",
    "op4_mixing": r"""
        WITH docs AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
        sums AS (SELECT source, sum(size) AS source_size FROM docs GROUP BY source),
        ranked AS (
            SELECT source, CAST(source_size AS BIGINT) AS source_size, 3 * source_size AS cap,
                   CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
            FROM sums),
        filled AS (
            SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
                      / CAST(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
            FROM ranked),
        final AS (SELECT min_by(level, cap / weight) AS level FROM filled WHERE level <= cap / weight),
        targets AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * level) AS target FROM ranked, final),
        rates AS (
            SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
                   CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 AS draw
            FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source)
        SELECT doc_id, size, source_size, target, size * CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
        FROM rates""",
    "op9_decontaminate": r"""
        WITH words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents),
        item_words AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark),
        windows AS (
            SELECT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + 9], ' ') AS pattern
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, least(1, len(w))) + 1)) AS i FROM item_words)),
        lengths AS (SELECT DISTINCT n FROM windows),
        places AS (
            SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS pattern
            FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM words, lengths)),
        found AS (SELECT doc_id, item_id, i, n FROM places JOIN windows USING (n, pattern)),
        hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op6_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents),
        sets AS (
            SELECT doc_id, list_distinct([array_to_string(w[i : i + 4], ' ') for i in range(1, greatest(len(w) - 4, least(1, len(w))) + 1)]) AS s FROM words),
        shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
        pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, max(a.n) + max(b.n) AS sizes
            FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
        close AS (SELECT a, b FROM pairs WHERE common >= 0.8 * (sizes - common) - 1e-9),
        links AS (SELECT a, b FROM close UNION ALL SELECT b, a FROM close),
        reach AS (SELECT doc_id, doc_id AS spot FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.spot)
        SELECT doc_id, min(spot) AS class_id, (SELECT count(*) FROM links WHERE a = r.doc_id) AS n_links FROM reach r GROUP BY doc_id""",
    "op10_suffix_dedup": r"""
        WITH bytes AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        strings AS (
            SELECT doc_id, s, substr(h, 2 * s + 1, 200) AS k FROM (SELECT doc_id, h, unnest(range(greatest(length(h) // 2 - 99, 0))) AS s FROM bytes)),
        repeated AS (
            SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY md5_number(k) ORDER BY doc_id, s) AS n FROM strings) WHERE n > 1),
        marked AS (
            SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 100 THEN 0 ELSE 1 END AS opens FROM repeated),
        runs AS (SELECT doc_id, s, sum(opens) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM marked),
        spans AS (SELECT doc_id, min(s) AS lo, max(s) + 100 AS hi FROM runs GROUP BY doc_id, run),
        gaps AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS since FROM spans),
        cut AS (
            SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last, string_agg(substr(h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) AS head
            FROM gaps JOIN bytes USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) AS kept_sha256
        FROM bytes LEFT JOIN cut USING (doc_id)""",
    "op11_convtrie": r"""
        WITH turns AS (
            SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
            FROM conversations WHERE conv_id IS NOT NULL),
        own AS (
            SELECT conv_id, list(digest ORDER BY turn NULLS FIRST, digest) AS ds, list(words ORDER BY turn NULLS FIRST, digest) AS ws FROM turns GROUP BY conv_id),
        shared AS (
            SELECT *, conv_id - conv_id % 20 AS base, CRC32_OF_ID % 4 AS h
            FROM own),
        rebuilt AS (
            SELECT c.conv_id, CASE WHEN c.conv_id = c.base THEN c.ds ELSE list_concat(coalesce(b.ds[1:c.h], []), c.ds[c.h + 1:]) END AS ds,
                   CASE WHEN c.conv_id = c.base THEN c.ws ELSE list_concat(coalesce(b.ws[1:c.h], []), c.ws[c.h + 1:]) END AS ws
            FROM shared c LEFT JOIN own b ON b.conv_id = c.base),
        members AS (
            SELECT conv_id, d, array_to_string(ds[1:d], '') AS node, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w, d = len(ds) AS ends
            FROM (SELECT *, unnest(range(len(ds) + 1)) AS d FROM rebuilt)),
        nodes AS (
            SELECT node, d, CASE WHEN d > 0 THEN left(node, 64 * (d - 1)) END AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, min(w) AS w,
                   sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
            FROM members GROUP BY node, d),
        children AS (SELECT parent, count(*) AS n FROM nodes GROUP BY parent),
        full_nodes AS (SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children ON children.parent = nodes.node),
        subtrees AS (
            SELECT left(node, 64 * k) AS top, sum((n_convs - 1) * w) AS saved, count(*) FILTER (n_children = 0) AS leaves
            FROM (SELECT *, unnest(range(d + 1)) AS k FROM full_nodes) GROUP BY top)
        SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256
        FROM full_nodes n JOIN subtrees s ON s.top = n.node LEFT JOIN nodes p ON p.node = n.parent""".replace("CRC32_OF_ID", CRC32_OF_ID.replace("doc_id", "conv_id")),
    "op12_qualityrules": r"""
        WITH texts AS (
            SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        windows AS (
            SELECT body, unnest(flatten([[i, i + 1, i + 2] FOR i IN range(1, len(w) - 1) IF len(list_filter(g, lambda x: x = g[i])) > 1])) AS place
            FROM (SELECT body, w, [w[i : i + 2] FOR i IN range(1, len(w) - 1)] AS g FROM (SELECT DISTINCT body, w FROM texts))),
        repeated AS (SELECT body, count(DISTINCT place) AS n FROM windows GROUP BY body),
        lines AS (
            SELECT body, len(l) - len(list_distinct(l)) AS n FROM (SELECT DISTINCT body, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM texts)),
        counts AS (
            SELECT doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN w]), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(body, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
                   CAST(lines.n AS BIGINT) AS n_dup_lines, CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words
            FROM texts JOIN lines USING (body) LEFT JOIN repeated USING (body)),
        judged AS (
            SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                   [least(100 * word_chars // greatest(n_words, 1), 100000), -least(100 * word_chars // greatest(n_words, 1), 100000), least(1000 * n_symbols // greatest(n_words, 1), 100000),
                    least(1000 * n_dup_lines // greatest(n_words, 1), 100000), least(1000 * n_repeat_words // greatest(n_words, 1), 100000)] AS v
            FROM counts),
        labelled AS (
            SELECT stratum, v, good, CRC32_OF_ID % 4 = 0 AS proposes
            FROM judged JOIN (SELECT doc_id, bool_or(quality = 1) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id) USING (doc_id) WHERE NOT base_failed),
        rule_values AS (SELECT stratum, unnest(range(1, 6)) AS rule, unnest(v) AS value FROM labelled WHERE proposes AND good),
        ranked AS (SELECT stratum, rule, value, rank() OVER (PARTITION BY stratum, rule ORDER BY value DESC) - 1 AS above, count(*) OVER (PARTITION BY stratum, rule) AS n FROM rule_values),
        cuts AS (
            SELECT stratum, rule, list_concat([max(value) + 400, max(value) + 200, max(value) + 100, max(value) + 50],
                   [min(value) FILTER (above = 0), min(value) FILTER (1000 * above <= n), min(value) FILTER (1000 * above <= 2 * n), min(value) FILTER (1000 * above <= 3 * n), min(value) FILTER (1000 * above <= 4 * n),
                    min(value) FILTER (1000 * above <= 5 * n), min(value) FILTER (1000 * above <= 7 * n), min(value) FILTER (1000 * above <= 10 * n), min(value) FILTER (1000 * above <= 15 * n), min(value) FILTER (1000 * above <= 20 * n)]) AS c
            FROM ranked GROUP BY stratum, rule),
        path AS (
            SELECT stratum, step, list(cut ORDER BY rule) AS cutoffs FROM (SELECT stratum, rule, unnest(range(14)) AS step, unnest(c) AS cut FROM cuts) GROUP BY stratum, step),
        met AS (SELECT stratum, step, good, proposes, len([i FOR i IN range(1, 6) IF v[i] > cutoffs[i]]) > 0 AS rejected FROM labelled JOIN path USING (stratum)),
        sums AS (
            SELECT stratum, step, count(*) FILTER (good AND NOT proposes) AS n, count(*) FILTER (good AND NOT proposes AND rejected) AS lost, count(*) FILTER (NOT good AND proposes AND rejected) AS caught
            FROM met GROUP BY stratum, step HAVING n > 0),
        tested AS (
            SELECT *, list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - CASE WHEN n = i THEN 0 ELSE lgamma(n - i + 1) END + i * ln(0.02) + (n - i) * ln(0.98)) FOR i IN range(lost + 1)]) AS p FROM sums),
        passed AS (
            SELECT *, bool_and(p <= 0.05 / (SELECT count(DISTINCT stratum) FROM tested)) OVER (PARTITION BY stratum ORDER BY step) AS ok FROM tested),
        chosen AS (SELECT stratum, arg_max(step, caught * 100 - step) AS step FROM passed WHERE ok GROUP BY stratum),
        cutoffs AS (SELECT stratum, cutoffs FROM path JOIN chosen USING (stratum, step))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(len([i FOR i IN range(1, 6) IF v[i] > cutoffs[i]]) = 0, true) AS kept
        FROM judged LEFT JOIN cutoffs USING (stratum)""".replace("CRC32_OF_ID", CRC32_OF_ID),
    "op13_filteraudit": r"""
        WITH RECURSIVE texts AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        judged AS (
            SELECT part, list_concat(CASE WHEN len(w) < 200 THEN ['A'] ELSE [] END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN ['B'] ELSE [] END,
                       CASE WHEN 100 * len(regexp_extract_all(body, '[A-Z]')) > 2 * length(body) THEN ['C'] ELSE [] END, CASE WHEN regexp_matches(body, '[#$%&*|]') THEN ['D'] ELSE [] END,
                       CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY body) THEN ['E'] ELSE [] END) AS failed,
                   EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = t.doc_id AND quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = t.doc_id AND toxic = 1) AS toxic
            FROM texts t),
        orders AS (
            SELECT '' AS filter_order UNION ALL SELECT filter_order || f FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE NOT contains(filter_order, f)),
        steps AS (
            SELECT filter_order, step, filter_order[step] AS f, string_split(left(filter_order, step - 1), '') AS before
            FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders WHERE length(filter_order) = 5)),
        counted AS (
            SELECT part, filter_order, step, f, count(*) FILTER (NOT list_has_any(failed, before) AND NOT list_contains(failed, f)) AS kept,
                   count(*) FILTER (NOT list_has_any(failed, before) AND list_contains(failed, f)) AS removed, count(*) FILTER (list_has_any(failed, before) AND list_contains(failed, f)) AS redundant,
                   count(*) FILTER (failed = [f]) AS unique_fails, count(*) FILTER (NOT list_has_any(failed, before) AND list_contains(failed, f) AND good) AS good_lost,
                   count(*) FILTER (NOT list_has_any(failed, before) AND list_contains(failed, f) AND toxic) AS toxic_lost
            FROM judged, steps GROUP BY part, filter_order, step, f)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
        FROM counted""",
}

ORACLE_SQL["op3_toolcalls"] += " UNION ALL " + ORACLE_SQL["op3_messages"]
