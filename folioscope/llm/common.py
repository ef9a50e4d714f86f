"""What the training-data operators share: shared-folder tables, byte-level words, rolling hashes.

The numpy helpers work on Arrow buffers inside tasks, in pieces of bounded size, so a batch
costs a few passes over its bytes whatever the lengths of its texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Positions that a rolling hash takes at once.
PIECE = 1 << 18


# ---------------------------------------------------------------- tables in the shared folder


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, or one in the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_work"
    return f"{base.rstrip('/')}/folioscope-{uuid.uuid4().hex}"


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Has the file system that holds the path remove it when the application ends."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


def materialize(df: DataFrame) -> DataFrame:
    """Writes the rows once to the shared folder and returns the written table: its lineage starts there."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows and bytes that pass to a Python worker at once.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Has the session hand rows to Python workers in small batches, unless they are smaller already.

    The default, 10,000 rows or 64 MB, costs each of an executor's tasks several copies of that.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        size = int(now.rstrip("b")) if now and now.rstrip("b").lstrip("-").isdigit() else 0
        if size <= 0 or size > most:
            spark.conf.set(key, most)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, taken: Iterable[str]) -> str:
    """The name, with underscores after it until no other column has it; Spark doesn't tell capitals apart."""
    folded = {t.casefold() for t in taken}
    while name.casefold() in folded:
        name += "_"
    return name


def is_held_out(doc_id: Column) -> Column:
    """The fold that no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


# ---------------------------------------------------------------- rows of an Arrow batch as bytes


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes in one array and the n + 1 offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary()).fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slabs(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Splits rows into ranges [lo, hi) of at most so many bytes each, or one row where that alone is longer."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def whole_groups(tables: Iterable[pa.RecordBatch], keys: list[str], rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Regroups batches that are sorted by keys into tables that never split a group."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in tables:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts = group_starts(table, keys)
        if len(starts) > 1:
            yield table.slice(0, int(starts[-1]))
            table = table.slice(int(starts[-1]))
        held, count = table.to_batches(), table.num_rows
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """First rows of the groups of a table that is sorted by integer keys."""
    change = np.zeros(table.num_rows, bool)
    change[:1] = True
    for key in keys:
        values = table.column(key).to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(change)


# ---------------------------------------------------------------- hashes

#: The prime 2**61 - 1 that span hashes are taken modulo, and the base of their polynomials. A power of two as modulus
#: would be quicker, but lets some long strings of a regular pattern collide whatever the base.
PRIME = (1 << 61) - 1
P61 = U64(PRIME)
BASE = 0x9E3779B97F4A7C15 % PRIME
INVERSE = pow(BASE, -1, PRIME)
#: An odd base for the window hashes that only bring equal strings together, modulo 2**64.
WINDOW_BASE = 0x9E3779B97F4A7C15
LOW31, LOW30, LOW29 = U64((1 << 31) - 1), U64((1 << 30) - 1), U64((1 << 29) - 1)


def reduced(x: np.ndarray) -> np.ndarray:
    """64-bit values modulo the prime."""
    x = (x & P61) + (x >> U64(61))
    return np.where(x >= P61, x - P61, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, of values below it: from halves of 31 bits."""
    a_high, a_low, b_high, b_low = a >> U64(31), a & LOW31, b >> U64(31), b & LOW31
    middle = a_low * b_high + a_high * b_low
    return reduced(a_high * b_high * U64(2) + (middle >> U64(30)) + ((middle & LOW30) << U64(31)) + a_low * b_low)


def prime_powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo the prime."""
    out = np.ones(1, U64)
    while len(out) < n:
        out = np.concatenate((out, times(out, np.full(1, pow(base, len(out), PRIME), U64))))
    return out[:n]


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@cache
def span_tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo the prime, for a piece and its end."""
    return prime_powers(BASE, PIECE + 1), prime_powers(INVERSE, PIECE + 1)


@cache
def window_tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the window base and of its inverse modulo 2**64, for a piece and its end."""
    return powers(WINDOW_BASE, PIECE + 1), powers(pow(WINDOW_BASE, -1, 1 << 64), PIECE + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


class PieceSums:
    """Sums of codes times powers of the base over at most PIECE codes; exact, in two halves of the powers."""

    def __init__(self, codes: np.ndarray):
        power, n = span_tables()[0], len(codes)
        wide = codes.astype(U64)
        self.low, self.high = np.zeros(n + 1, U64), np.zeros(n + 1, U64)
        np.cumsum(wide * (power[:n] & U64(0xFFFFFFFF)), out=self.low[1:])  # below 2**59
        np.cumsum(wide * (power[:n] >> U64(32)), out=self.high[1:])  # below 2**56

    def between(self, starts, ends) -> np.ndarray:
        """Sums over codes[start:end] modulo the prime."""
        high = self.high[ends] - self.high[starts]
        return reduced(((high & LOW29) << U64(32)) + (high >> U64(29)) + (self.low[ends] - self.low[starts]))


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each `width` consecutive codes, of at most PIECE codes, to bring equal ones together."""
    forward, back = window_tables()
    sums = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes.astype(U64) * forward[: len(codes)], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * back[: max(0, len(codes) - width + 1)])


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of codes[start:end] for each span, modulo the prime and of the length; spans are in order and don't overlap.

    Works in pieces: temporary arrays don't grow with the text. A span's parts in several pieces add up.
    """
    back = span_tables()[1]
    total = np.zeros(len(starts), U64)
    for lo in range(0, len(codes), PIECE):
        hi = min(len(codes), lo + PIECE)
        a, b = int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(starts, hi))  # spans with a part within
        if a >= b:
            continue
        begin, end = np.maximum(starts[a:b], lo), np.minimum(ends[a:b], hi)
        part = times(PieceSums(codes[lo:hi]).between(begin - lo, end - lo), back[begin - lo])
        if begin[0] > starts[a]:  # a span that began in an earlier piece: the part counts from the span's start
            part[:1] = times(part[:1], np.full(1, pow(BASE, int(begin[0] - starts[a]), PRIME), U64))
        total[a:b] = reduced(total[a:b] + part)
    return mix(total ^ (ends - starts).astype(U64) << U64(40))


# ---------------------------------------------------------------- words


def _word_codes() -> np.ndarray:
    codes = np.zeros(256, np.uint8)
    for b in range(256):
        if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80:
            codes[b] = b
        elif 0x41 <= b <= 0x5A:
            codes[b] = b + 32
    return codes


#: Bytes of words with A-Z lower-cased, others 0: ASCII digits and letters, and all that is not ASCII.
WORD_CODES = _word_codes()


class Words:
    """Words of consecutive rows: spans in `codes`, the row of each word, 64-bit hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        offsets = offsets - offsets[0]
        self.codes = WORD_CODES[data]
        inside = self.codes > 0
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        opens[cuts] = inside[cuts]
        closes[cuts - 1] = inside[cuts - 1]
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        #: Word i of row r has index first[r] <= i < first[r + 1].
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = span_hashes(self.codes, self.starts, self.ends)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
