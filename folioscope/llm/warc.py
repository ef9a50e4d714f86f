"""WARC archives: written with an index, read back by coalesced byte ranges.

Every record is a gzip member of its own. Tasks write archive files into a shared folder and return an
index row (file, offset, length, URL, digest, ...) per record, so that any selection of records is read
from the index alone: sorted by place, neighbours joined into one range, each range read at once. A
file counts only by its index rows: what a lost or repeated task left behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import delete_on_exit, materialize, shared_dir, small_batches

#: Bytes after which a task begins another archive file.
FILE_BYTES = 256 << 20
#: Bytes of one range read at most (or one record), and of a gap that is read over.
RANGE_BYTES, GAP_BYTES = 8 << 20, 64 << 10
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LINE_ENDS = re.compile("[\r\n]+")
RECORD_ID = "<urn:x-page:{}>"

INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, record_type string, refers_to long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def base32(digits: Column) -> Column:
    """40 hexadecimal digits in base 32: each five of them are four characters."""
    parts = []
    for i in range(8):
        value = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), F.shiftright(value, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def _folder(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "", 1))


def _head(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {LINE_ENDS.sub(' ', str(v))}" for k, v in fields if v is not None), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record, compressed. A revisit has the HTTP head of its capture, with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields: list[tuple[str, object]] = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", RECORD_ID.format(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", RECORD_ID.format(refers_to))]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(_head(fields, http if revisit else http + payload)) + pack.flush()


def _page(record_id: str) -> int | None:
    name = record_id.rpartition(":")[2].rstrip(">")
    return None if name == "None" else int(name)


def parse_record(data: bytes) -> dict[str, object]:
    """What a record holds; digest and length of a response are those of its payload, checked against its head."""
    raw = zlib.decompress(data, 31)
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x.split(b": ")[1] for x in http.split(b"\r\n") if x.startswith(b"Content-Length: ")))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()) != (length, digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": _page(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": _page(fields["WARC-Refers-To"]) if revisit else None,
        "payload": None if revisit else payload,
    }


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _folder(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, body, digest, first, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{base}/{name}", compression=None)
                    record = record_bytes(page_id, url, (body or "").encode(), digest, first, revisit)
                    out.write(record)
                    rows.append((page_id, url, f"{folder}/{name}", at, len(record), digest, "revisit" if revisit else "response", first if revisit else None))
                    at += len(record)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return write


def write_archives(pages: DataFrame, folder: str, *, least_revisit: int = 0) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) under the folder and returns the written index.

    The payload is the html in UTF-8; null is empty. Of rows with equal payloads of least_revisit bytes or
    more, those with the smallest page_id are responses and the others revisit them; a null page_id
    counts as larger than all others, and payloads that only such rows have are responses. Line
    ends in a URL become blanks; a null URL is left out. The folder must be one that all machines share.
    """
    small_batches(pages.sparkSession)
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumn("sha1", F.sha1(F.col("body").cast("binary")))
    # Payloads never travel by their digests, of which one may have very many pages, but with their own pages.
    digests = rows.select("page_id", "sha1", F.octet_length("body").alias("size")).distinct()
    firsts = materialize(digests.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("times")).where("times > 1 AND first IS NOT NULL"))
    revisits = digests.where(F.col("size") >= least_revisit).join(firsts, "sha1").where(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "sha1", "first")
    revisits = materialize(revisits)
    same = rows["page_id"].eqNullSafe(revisits["page_id"]) & (rows["sha1"] == revisits["sha1"])
    typed = rows.join(revisits, same, "left").select(rows["page_id"], "url", "body", base32(rows["sha1"]).alias("digest"), "first", F.col("first").isNotNull().alias("revisit"))
    files, base = _folder(folder)
    files.create_dir(base)
    return materialize(typed.mapInArrow(_writer(folder), INDEX))


def coalesced_ranges(index: DataFrame) -> DataFrame:
    """(file, start, stop, places) of an index: neighbours in a file read as one, at most about RANGE_BYTES.

    Windows run within a stretch of RANGE_BYTES of one file, so no group grows with the archive.
    """
    stretch = F.floor(F.col("offset") / RANGE_BYTES)
    rows = index.select("file", stretch.alias("stretch"), "offset", (F.col("offset") + F.col("length")).alias("stop"))
    order = Window.partitionBy("file", "stretch").orderBy("offset")
    rows = rows.withColumn("apart", F.coalesce(F.col("offset") - F.lag("stop").over(order) > GAP_BYTES, F.lit(True)).cast("int"))
    rows = rows.withColumn("run", F.sum("apart").over(order))
    ranges = rows.groupBy("file", "stretch", "run").agg(F.min("offset").alias("start"), F.max("stop").alias("stop"), F.sort_array(F.collect_list(F.struct("offset", "stop"))).alias("places"))
    return ranges.select("file", "start", "stop", "places")


def _read(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORD.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for file, start, stop, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                folder, _, name = file.rpartition("/")
                files, base = _folder(folder)
                with files.open_input_file(f"{base}/{name}") as source:
                    data = source.read_at(stop - start, start)
                found = [parse_record(data[p["offset"] - start : p["stop"] - start]) for p in places]
                columns = [[x[n] if with_payload or n != "payload" else None for x in found] for n in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return read


def read_records(index: DataFrame, *, with_payload: bool = True) -> DataFrame:
    """The records of the given index rows (all, or any selection): page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, payload (null for revisits). Damaged records raise."""
    return coalesced_ranges(index).repartition("file", "start").mapInArrow(_read(with_payload), RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages to archives in the shared folder and reads them back: one row per page, without the payload."""
    spark = pages.sparkSession
    folder = shared_dir(spark)
    delete_on_exit(spark, folder)
    index = write_archives(pages, folder)
    return read_records(index, with_payload=False).drop("payload")
