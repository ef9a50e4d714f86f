"""Exact substring deduplication with longest-previous-factor arrays.

A byte goes if a string of `length` bytes that covers it also starts earlier in the corpus. Whether a
position's string starts earlier is what the longest-previous-factor (LPF) array says, and LPF comes
from a position's previous and next smaller positions in suffix order. One suffix array over the whole
corpus can't be spread over machines, so positions are first brought together with all that may match
them: strings that are equal have the same minimizer (the smallest hash of the `GRAM`-byte substrings
within), so runs of positions with one minimizer meet in one place, and suffix order is needed only
among runs that share a minimizer and differ.

1. Texts that equal an earlier document's whole text are told by two hashes and their sizes.
2. The rest become runs: (minimizer, hash of the run's bytes, document, start, count). Only those whose
   minimizer occurs again go on: minimizers are counted first, with partial sums in every task.
3. Runs whose bytes equal an earlier run's are repeats as a whole: groups of equal runs are reduced to
   their first, which is joined back. The firsts, where other kinds share the minimizer, fetch their bytes.
4. Runs with one minimizer are put into suffix order, eight bytes a step. Where neighbours in that order
   share `length` bytes, the nearest neighbours above and below with smaller positions give LPF, and a
   position with an LPF of `length` or more is a repeat.
5. A minimizer with very many kinds of runs is split by the hash of the string and dealt over blocks; what
   is first in its block meets the firsts of the other blocks in a second round, so that no task holds
   the whole group, even of one string that very many different runs contain.
6. The repeated positions of each document cut its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import PIECE, U64, PieceSums, group_starts, materialize, mix, slabs, small_batches, span_tables, text_bytes, times, whole_groups, window_hashes

LENGTH = 100
#: Bytes of the substrings whose smallest hash brings equal strings together.
GRAM = 32
#: Kinds of runs that one group of a minimizer holds before it is split.
GROUP = 4096
#: Bits of a packed position that count a run's strings.
COUNT_BITS = 22
#: Bytes beyond the length by which suffixes are ordered.
DEEPER = 32
#: Bytes that one suffix ordering takes, as long as groups allow.
ORDER_BYTES = 1 << 19


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each `width` consecutive values."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def minimizer_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, *, prints: bool = True) -> dict[str, np.ndarray]:
    """Runs of consecutive string starts with one minimizer, never across rows.

    key: the minimizer; print: hash of the bytes that the run's strings cover (0 without prints); row, start and
    count; twice: whether the minimizer occurs at several places in the run.
    """
    back = span_tables()[1]
    gram = min(gram, length)
    n, step = len(data), PIECE - length
    row_end = offsets[1:]
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("key", "print", "row", "start", "count", "twice")}
    for lo in range(0, n, step):
        hi = min(n, lo + PIECE)
        m = hi - lo - length + 1
        if m <= 0:
            break
        grams = window_hashes(data[lo:hi], gram)
        low = U64((1 << 20) - 1)
        where = (_sliding_min(grams & ~low | np.arange(len(grams), dtype=U64), length - gram + 1) & low).astype(np.int64)[:m]
        m = min(m, step)
        where = where[:m]
        row = np.searchsorted(row_end, np.arange(lo, lo + m, 256), "right")
        row = np.repeat(row, 256)[:m]
        for cut in row_end[np.searchsorted(row_end, lo, "right") : np.searchsorted(row_end, lo + m, "left")]:  # rows that begin inside a stride
            a = int(cut - lo)
            b = min(m, -(-a // 256) * 256)
            row[a:b] = np.searchsorted(row_end, np.arange(lo + a, lo + b), "right")
        good = np.arange(lo, lo + m) + length <= row_end[row]
        new = np.ones(m, bool)
        new[1:] = (where[1:] != where[:-1]) | (row[1:] != row[:-1]) | ~good[:-1]
        first = np.flatnonzero(new & good)
        if not len(first):
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([False], good, [False])).astype(np.int8)) == -1)
        last = np.minimum(np.concatenate((first[1:], [m])), edge[np.searchsorted(edge, first, "right")])
        key = grams[where[first]]
        joined = np.zeros(len(first), bool)  # continues the run before it with the same minimizer at another place
        joined[1:] = (key[1:] == key[:-1]) & (first[1:] == last[:-1]) & (row[first[1:]] == row[first[:-1]])
        head = np.flatnonzero(~joined)
        begin, end = first[head], last[np.concatenate((head[1:], [len(first)])) - 1]
        stop = end + length - 1
        out["key"].append(key[head])
        if not prints:
            out["print"].append(np.zeros(len(begin), U64))
        else:
            out["print"].append(mix(times(PieceSums(data[lo:hi]).between(begin, stop), back[begin]) ^ (stop - begin).astype(U64) << U64(40)))
        out["row"].append(row[begin])
        out["start"].append(begin + lo - offsets[row[begin]])
        out["count"].append(end - begin)
        out["twice"].append(np.diff(np.concatenate((head, [len(first)]))) > 1)
    return {k: np.concatenate(v) if v else np.zeros(0, U64 if k in ("key", "print") else np.int64) for k, v in out.items()}


def _dense(values: np.ndarray) -> np.ndarray:
    """Places of 64-bit values in their order; equal values have equal places."""
    order = np.argsort(values)
    ordered = values[order]
    out = np.empty(len(values), np.int64)
    out[order] = np.concatenate((np.zeros(min(1, len(order)), np.int64), np.cumsum(ordered[1:] != ordered[:-1])))
    return out


def _heads(new: np.ndarray) -> np.ndarray:
    """For each place the last place at or before it where something new begins."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _refined(rank: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Ranks by (rank, own); a rank is that of the first place of its group, so groups only split."""
    key = rank << 32 | own
    order = np.argsort(key)
    key, block = key[order], rank[order]
    first = np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1]))
    head = np.concatenate((np.ones(min(1, len(key)), bool), block[1:] != block[:-1]))
    out = np.empty(len(rank), np.int64)
    out[order] = block + _heads(first) - _heads(head)
    return out


def _again(rank: np.ndarray) -> np.ndarray:
    """Which elements aren't alone in their rank; ranks are below the number of all."""
    return np.bincount(rank)[rank] > 1 if len(rank) else np.zeros(0, bool)


def _strings(words: np.ndarray, starts: np.ndarray, length: int) -> Iterator[np.ndarray]:
    """The strings at positions, eight bytes at a time; the last eight may overlap those before."""
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        yield words[starts + at]


def suffix_order(data: np.ndarray, ends: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of positions: indexes into starts, and the bytes that each suffix shares with the one above.

    starts: positions in order of precedence, `length` bytes or more before the end of their fragment (ends);
    no suffix goes beyond it. Suffixes that share `length` bytes with none, as hashes tell, are left out. Of
    each group of the others one is ranked by its first `length` bytes, eight a step, once all are compared
    with it; then all by DEEPER bytes more. Ties are in order of precedence.
    """
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.zeros(len(data), U64)
    for k in range(8):
        words = words << U64(8) | padded[k : k + len(data)].astype(U64)
    group = _dense(_string_hashes(data, length)[starts]) if len(starts) else np.zeros(0, np.int64)
    live = np.flatnonzero(_again(group))
    first, group = np.unique(group[live], return_index=True, return_inverse=True)[1:]
    if any((x != y).any() for x, y in zip(_strings(words, starts[live], length), _strings(words, starts[live[first]][group], length), strict=True)):
        first = group = np.arange(len(live))  # unequal strings of one hash: each is ranked by itself
    rank = np.zeros(len(first), np.int64)
    for own in _strings(words, starts[live[first]], length):
        split = np.flatnonzero(_again(rank))
        rank[split] = _refined(rank[split], _dense(own[split]))
    rank = _refined(np.zeros(len(live), np.int64), rank[group])
    own, together = starts[live], np.arange(len(live))
    left = ends[own] - own
    masks = ~((U64(1) << (U64(8) * np.arange(8, 0, -1, dtype=U64) - U64(1)) << U64(1)) - U64(1)) if len(live) else np.zeros(8, U64)
    masks = np.concatenate((masks, [~U64(0)]))  # of the first 0 to 8 bytes
    for at in range(length, length + DEEPER, 8):
        together = together[_again(rank)[together] & (left[together] > at)] if len(together) else together
        if not len(together):
            break
        split = np.flatnonzero(_again(rank))
        there = np.clip(left[split] - at, 0, 8)
        word = np.where(there > 0, words[np.minimum(own[split] + at, len(words) - 1)], 0) & masks[there]
        rank[split] = _refined(rank[split], _dense(word) << 4 | there)
    order = np.argsort(rank << 32 | np.arange(len(rank)))
    a, b = own[order[:-1]], own[order[1:]]
    most = np.minimum(left[order[:-1]], left[order[1:]])
    shared = np.zeros(len(a), np.int64)
    for at in [*range(0, length - 7, 8), *range(length, length + DEEPER, 8)]:
        if at == length and length % 8:
            tail = np.flatnonzero(shared == length - length % 8)
            shared[tail[words[a[tail] + length - 8] == words[b[tail] + length - 8]]] = length
        open_ = np.flatnonzero((shared == at) & (shared < most))
        if not len(open_):
            continue
        apart = words[np.minimum(a[open_] + at, len(words) - 1)] ^ words[np.minimum(b[open_] + at, len(words) - 1)]
        shared[open_] += sum((apart >> U64(56 - 8 * k) == 0).astype(np.int64) for k in range(8))
    return live[order], np.concatenate((np.zeros(min(1, len(order)), np.int64), np.minimum(shared, most)))


def nearest_smaller(places: np.ndarray, common: np.ndarray, reach: int) -> np.ndarray:
    """Bytes shared with the nearest element above that has a smaller place, in suffix order; 0 where there is none.

    places: positions in order of precedence, of suffixes in order; common: bytes that each shares with
    the one above. Looks at most 2**k >= reach elements back, by halving steps over tables of minima.
    """
    n, levels = len(places), max(1, int(reach).bit_length())
    lowest, least = [places], [common]
    for k in range(levels - 1):
        p, c = lowest[-1].copy(), least[-1].copy()
        step = 1 << k
        p[step:] = np.minimum(p[step:], lowest[-1][:-step])
        c[step:] = np.minimum(c[step:], least[-1][:-step])
        lowest.append(p)
        least.append(c)
    at, shared = np.arange(n) - 1, common.copy()
    for k in range(levels - 1, -1, -1):
        go = np.flatnonzero(at >= (1 << k) - 1)
        go = go[lowest[k][at[go]] > places[go]]
        shared[go] = np.minimum(shared[go], least[k][at[go]])
        at[go] -= 1 << k
    found = at >= 0
    found[found] = places[at[found]] < places[found]
    return np.where(found, shared, 0)


def longest_previous_factors(data: np.ndarray, ends: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """LPF of positions that are given in order of precedence: the bytes that each shares with the most similar earlier one.

    Values below `length` are reported as 0, and those above as far as suffixes are ordered (DEEPER bytes
    more). ends: of the fragment that each byte belongs to.
    """
    out = np.zeros(len(starts), np.int64)
    places, common = suffix_order(data, ends, starts, length)
    if not len(places):
        return out
    places, common = places.astype(np.int32), np.where(common >= length, common, 0).astype(np.int32)  # LPF is smaller beyond
    heads = np.flatnonzero(common == 0)
    reach = int(np.diff(np.concatenate((heads, [len(places)]))).max())
    above = nearest_smaller(places, common, reach)
    below = nearest_smaller(places[::-1], np.concatenate(([0], common[:0:-1])).astype(np.int32), reach)[::-1]
    out[places] = np.maximum(above, below)
    return out


def previous_factor(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For positions of one text in order of precedence, whether LPF reaches `length`: the same string starts at an earlier one."""
    return longest_previous_factors(data, np.full(len(data), len(data)), starts, length) >= length


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(flags.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _runs_of(length: int, gram: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("body"))
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for lo, hi in slabs(offsets):
                found = minimizer_runs(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], length, gram)
                key, mark, row, start, count, twice = found.values()
                place = start << COUNT_BITS | count << 1 | twice.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(mark.view(np.int64)), pa.array(ids[lo + row]), pa.array(place)], names=["key", "print", "id", "place"])

    return runs


def _keys_of(length: int, gram: int):
    """How often each minimizer has runs, counted per slab of text, and whether it occurs twice in one."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("body"))
            for lo, hi in slabs(offsets):
                found = minimizer_runs(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], length, gram, prints=False)
                key, at, many = np.unique(found["key"], return_inverse=True, return_counts=True)
                twice = np.bincount(at, found["twice"].astype(float), len(key)) > 0
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(many.astype(np.int64)), pa.array(twice.astype(np.int64))], names=["key", "times", "twice"])

    return keys


def _string_hashes(fragment: np.ndarray, length: int) -> np.ndarray:
    """A hash of each `length` bytes of a fragment."""
    step = PIECE - length + 1
    return np.concatenate([window_hashes(fragment[lo : lo + PIECE], length) for lo in range(0, max(1, len(fragment) - length + 1), step)])


#: Strings of a run, for suffix order; splits: parts of its minimizer's group by string hash, and blocks of each part.
FRAGMENT = "key long, part long, block long, splits long, id long, start long, fragment binary"
FRAGMENT_ARROW = pa.schema([(c, pa.int64()) for c in ("key", "part", "block", "splits", "id", "start")] + [("fragment", pa.binary())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _fragments_of(length: int):
    """Bytes of the runs that need suffix order; runs of a large group go to each part that has one of their strings."""

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            data, offsets = text_bytes(batch.column("body"))
            ids = batch.column("id").to_pylist()
            for r, runs in enumerate(batch.column("runs")):
                text = data[offsets[r] : offsets[r + 1]]
                for run in runs.as_py() or ():
                    splits = run["splits"]
                    if not splits:
                        continue
                    start, count = run["place"] >> COUNT_BITS, _count(run["place"])
                    fragment = text[start : start + count + length - 1]
                    parts = np.unique(_string_hashes(fragment, length) % U64(splits)).tolist() if splits > 1 else [0]
                    for part in parts:
                        rows.append((run["key"], part, (ids[r] + start) % splits, splits, ids[r], start, fragment.tobytes()))
                        size += len(fragment)
                    if size > 1 << 21:
                        yield _rows(rows, FRAGMENT_ARROW)
                        rows, size = [], 0
            yield _rows(rows, FRAGMENT_ARROW)

    return fragments


#: Repeated ranges (fragment null), and what is first in its block of a split group.
FOUND = "key long, part long, id long, place long, fragment binary"
FOUND_ARROW = pa.schema([(c, pa.int64()) for c in ("key", "part", "id", "place")] + [("fragment", pa.binary())])


def _repeats_of(length: int, groups: list[str]):
    """Repeated positions of fragments, group by group in suffix order: packed ranges of string starts.

    Of groups that are dealt over blocks, those strings follow that are in a block's own part and first there.
    """

    def order(table: pa.Table) -> pa.RecordBatch:
        data, offsets = text_bytes(table.column("fragment"))
        ids, begin = table.column("id").to_numpy(), table.column("start").to_numpy()
        splits, part, key = (table.column(c).to_numpy() for c in ("splits", "part", "key"))
        counts = np.diff(offsets) - length + 1
        bases = np.cumsum(counts) - counts
        row = np.repeat(np.arange(len(counts)), counts)
        within = np.arange(counts.sum()) - bases[row]
        starts = offsets[row] + within
        owned = np.ones(len(row), bool)
        for r in np.flatnonzero(splits > 1):
            owned[bases[r] : bases[r] + counts[r]] = _string_hashes(data[offsets[r] : offsets[r + 1]], length) % U64(splits[r]) == part[r]
        order = np.flatnonzero(owned)
        order = order[np.lexsort((begin[row[order]] + within[order], ids[row[order]]))]  # precedence: document, then start
        repeated = np.zeros(len(row), bool)
        repeated[order] = longest_previous_factors(data, np.repeat(offsets[1:], np.diff(offsets)), starts[order], length) >= length

        def ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Row, first string and number of strings of each run of flags."""
            gapped = np.zeros(len(row) + len(counts), bool)  # a gap after each fragment
            gapped[np.arange(len(row)) + row] = flags
            lo, hi = _spans(gapped)
            heads = bases + np.arange(len(counts))
            of = np.searchsorted(heads, lo, "right") - 1
            return of, lo - heads[of], hi - lo

        of, first, many = ranges(repeated)
        on, lead, more = ranges(owned & ~repeated & (splits > 1)[row])
        texts = [data[offsets[r] + a : offsets[r] + a + n + length - 1].tobytes() for r, a, n in zip(on, lead, more, strict=True)]
        both = np.concatenate((of, on))
        place = begin[both] + np.concatenate((first, lead)) << COUNT_BITS | np.concatenate((many, more)) << 1
        columns = [pa.array(key[both]), pa.array(part[both]), pa.array(ids[both]), pa.array(place), pa.array([None] * len(of) + texts, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, schema=FOUND_ARROW)

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, groups, 1 << 14):
            size = np.cumsum(pa.compute.binary_length(table.column("fragment")).to_numpy())
            starts = group_starts(table, groups)
            lo = 0
            while lo < table.num_rows:
                base = size[lo - 1] if lo else 0
                fit = starts[(starts > lo) & (size[starts - 1] - base <= ORDER_BYTES)]
                after = starts[starts > lo]
                hi = int(fit[-1]) if len(fit) and size[-1] - base > ORDER_BYTES else int(after[0]) if size[-1] - base > ORDER_BYTES and len(after) else table.num_rows
                yield order(table.slice(lo, hi - lo))
                lo = hi

    return repeats


def _ordered(fragments: DataFrame, groups: list[str], length: int) -> DataFrame:
    return fragments.repartition(*groups).sortWithinPartitions(*groups).mapInArrow(_repeats_of(length, groups), FOUND)


CUT = "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept_sha256:string,kept:binary,text:string>"
CUT_ARROW = [pa.field("n_bytes", pa.int64()), pa.field("n_removed", pa.int64()), pa.field("n_spans", pa.int64()), pa.field("kept_sha256", pa.string()), pa.field("kept", pa.binary()), pa.field("text", pa.string())]


def _cut_of(length: int, with_bytes: bool):
    def cut(body: pa.Array, copy: pa.Array, places: pa.Array, ranges: pa.Array) -> pa.Array:
        data, offsets = text_bytes(body)
        whole = copy.to_numpy(zero_copy_only=False)
        place, place_ends = _lists(places)
        span, span_ends = _lists(ranges)
        n_bytes, n_removed, n_spans, sha, kept, texts = [], [], [], [], [], []
        for r in range(len(body)):
            text = data[offsets[r] : offsets[r + 1]]
            n = len(text)
            own = place[place_ends[r] : place_ends[r + 1]]
            pairs = span[span_ends[r] : span_ends[r + 1]]
            if whole[r] and n >= length:
                spans, rest = 1, b""
            elif not len(own) and not len(pairs):
                spans, rest = 0, text.tobytes()
            else:
                gone = np.zeros(n + 1, np.int32)
                start = own >> COUNT_BITS
                np.add.at(gone, np.concatenate((start, pairs >> COUNT_BITS)), 1)
                np.add.at(gone, np.concatenate((start + _count(own), (pairs >> COUNT_BITS) + _count(pairs))) + length - 1, -1)
                gone = np.cumsum(gone)[:-1] > 0
                spans, rest = len(_spans(gone)[0]), text[~gone].tobytes()
            n_bytes.append(n)
            n_removed.append(n - len(rest))
            n_spans.append(spans)
            sha.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest if with_bytes else None)
            texts.append(rest.decode("utf-8", "ignore") if with_bytes and body[r].is_valid else None)
        return pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip((n_bytes, n_removed, n_spans, sha, kept, texts), CUT_ARROW, strict=True)], fields=CUT_ARROW)

    # Not to be worked out again where a filter on it could be moved below.
    return F.arrow_udf(cut, CUT).asNondeterministic()


def _count(place):
    return (place & (1 << COUNT_BITS) - 1) >> 1


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists of integers, and the offsets of each row's; null lists are empty."""
    sizes = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def cut_repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, with_bytes: bool = True) -> tuple[DataFrame, Column]:
    """Documents without their repeated bytes: a frame of (rest, body, cut) and the column cut, a struct of n_bytes,
    n_removed, n_spans, kept_sha256 and, with_bytes, kept and text (kept without parts of characters).

    rest is a struct of the document's other columns, whatever their names. Earlier means a smaller
    doc_id, or the same document and an earlier start. Null and empty texts have no bytes; texts shorter
    than `length` stay. A null doc_id comes before all others. Rows that repeat an id and its text are one
    document and are cut alike; different texts under one id come in order of their hashes.
    """
    if length < 8:
        raise ValueError("strings of fewer than 8 bytes aren't supported")
    small_batches(docs.sparkSession)
    body, doc, named = F.col("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").isNotNull()
    key = ["named", "doc", "mark"]
    plain = F.coalesce(body, F.lit(""))
    mark = F.xxhash64(plain)
    others = [c for c in docs.columns if c != "text"]
    texts = docs.select(F.struct(*others).alias("rest"), body.alias("body"), doc.alias("doc"), named.alias("named"), mark.alias("mark")).repartition(*key)

    # One row per document, numbered in order of precedence; written, as a range partitioning made anew may number otherwise.
    slim = docs.select(doc.alias("doc"), named.alias("named"), mark.alias("mark"), F.xxhash64(F.lit("other"), plain).alias("mark2"), F.octet_length(plain).alias("size")).distinct()
    numbered = materialize(slim.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("id", F.monotonically_increasing_id()))
    # Tables that are joined back to rows of which one group may hold very many are written first: so Spark can split such a group.
    firsts = materialize(numbered.groupBy("mark", "mark2", "size").agg(F.min("id").alias("first"), F.count("*").alias("times")).where("times > 1"))
    known = numbered.join(firsts, ["mark", "mark2", "size"], "left").select(*key, "size", "id", F.coalesce(F.col("id") > F.col("first"), F.lit(False)).alias("copy"))
    known = materialize(known)

    fresh = texts.join(known.where(~F.col("copy") & (F.col("size") >= length)).select(*key, "id"), key).select("rest", "body", "id")
    keys = fresh.mapInArrow(_keys_of(length, gram), "key long, times long, twice long").groupBy("key").agg(F.sum("times").alias("times"), F.max("twice").alias("twice"))
    again = materialize(keys.where("times > 1 OR twice = 1").select("key"))
    runs = materialize(fresh.mapInArrow(_runs_of(length, gram), "key long, print long, id long, place long").join(again, "key"))
    kinds = materialize(runs.groupBy("key", "print").agg(F.min(F.struct("id", "place")).alias("lead"), F.max(F.col("place").bitwiseAND(F.lit(1))).alias("twice")))
    groups = materialize(kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.max("twice").alias("twice")).where("kinds > 1 OR twice = 1"))
    leads = kinds.join(groups.select("key", "kinds"), "key").select("lead.id", "lead.place", "key", F.ceil(F.col("kinds") / GROUP).cast("long").alias("splits"))
    later = runs.join(kinds.select("key", "print", "lead"), ["key", "print"]).where(F.struct("id", "place") != F.col("lead")).select("id", "place", "key", F.lit(0).cast("long").alias("splits"))
    by_doc = materialize(leads.unionByName(later).groupBy("id").agg(F.collect_list(F.struct("place", "key", "splits")).alias("runs")))
    found = by_doc.join(known.select(*key, "id"), "id")

    fetched = texts.join(found, key).select("rest", "body", "id", "runs")
    fragments = fetched.mapInArrow(_fragments_of(length), FRAGMENT)
    once = materialize(_ordered(fragments, ["key", "part", "block"], length))
    second = once.where("fragment IS NOT NULL").select("key", "part", F.lit(0).cast("long").alias("block"), F.lit(1).cast("long").alias("splits"), "id", F.shiftright("place", COUNT_BITS).alias("start"), "fragment")
    repeats = once.where("fragment IS NULL").select("id", "place").unionByName(_ordered(second, ["key", "part"], length).select("id", "place"))
    ranges = repeats.groupBy("id").agg(F.collect_list("place").alias("ranges"))
    told = known.join(by_doc.join(ranges, "id", "left"), "id", "left")
    whole = F.transform(F.filter("runs", lambda run: run["splits"] == 0), lambda run: run["place"])
    told = told.select(*key, "copy", whole.alias("places"), "ranges")
    done = texts.join(told, key)
    return done.select("rest", "body", _cut_of(length, with_bytes)("body", "copy", "places", "ranges").alias("cut")), F.col("cut")


def repeat_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (see cut_repeats)."""
    done, cut = cut_repeats(docs.select("doc_id", "text"), with_bytes=False, **options)
    return done.select("rest.doc_id", cut["n_bytes"].alias("n_bytes"), cut["n_removed"].alias("n_removed"), cut["n_spans"].alias("n_spans"), cut["kept_sha256"].alias("kept_sha256"))


def without_repeats(docs: DataFrame, *, least: int = 1, **options) -> DataFrame:
    """The documents with repeated bytes cut from their texts; parts of characters that a cut leaves go too. Documents
    cut to fewer than `least` bytes go; those without repeats stay. n_chars, where there is one, counts the rest."""
    done, cut = cut_repeats(docs, **options)
    kept = done.where((cut["n_removed"] == 0) | (cut["n_bytes"] - cut["n_removed"] >= least))
    text = F.when(cut["n_removed"] == 0, F.col("body")).otherwise(cut["text"])
    columns = {c: F.col("rest")[c] for c in docs.columns if c != "text"} | {"text": text}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(cut["n_removed"] == 0, columns["n_chars"]).otherwise(F.char_length(text)).cast(docs.schema["n_chars"].dataType)
    return kept.select(*(columns[c].alias(c) for c in docs.columns))
