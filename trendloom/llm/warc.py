"""WARC archives: written one gzip member per record, read back in byte ranges.

A reader's task has a byte range of a file. It looks for the first bytes of a
gzip member, takes a place for a record only if what is decoded there begins
as one, and owns the records that start in its range, wherever they end.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, functions as F

from trendloom.llm.common import arrow_schema, cut_lineage, rows_batch, small_batches
from trendloom.llm.files import new_file, new_folder, open_input, open_output

FILE_BYTES = 64 << 20
SPLIT_BYTES = 4 << 20
#: Payloads of at least so many bytes are written once.
REVISIT_BYTES = 0
DATE = "2026-01-01T00:00:00Z"
LEVEL = 5

_MAGIC = b"\x1f\x8b\x08"
_PIECE = 64 << 10
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BREAKS = re.compile(r"[\x00-\x20\x7f]")


def bare_digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One record, not compressed; a revisit has the response's headers and no payload."""
    def name(key: int | None) -> str:
        return f"<urn:page:{'' if key is None else key}>"

    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(page_id)),
            ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", _BREAKS.sub(lambda m: quote(m[0]), url)))
    head += [("WARC-Payload-Digest", f"sha1:{bare_digest(payload)}"), ("X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        head += [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", _PROFILE)]
        block = http
    else:
        block = http + payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    packer = zlib.compressobj(level, wbits=31)
    return packer.compress(data) + packer.flush()


def parse(data: bytes) -> tuple:
    """page_id, url, record_type, refers_to, payload (None for revisits), payload_bytes, payload_digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode().split("\r\n")[1:]:
        key, _, value = line.partition(": ")
        fields[key.lower()] = value
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")

    def number(field: str) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(field, ""))
        return int(found[1]) if found else None

    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    payload = None
    if fields["warc-type"] == "response":
        payload = rest[:size].partition(b"\r\n\r\n")[2]
        if bare_digest(payload) != digest:
            raise ValueError("a payload does not match its digest")
    count = int(fields["x-payload-length"]) if payload is None else len(payload)
    return (number("warc-record-id"), fields.get("warc-target-uri"), fields["warc-type"],
            number("warc-refers-to"), payload, count, digest)


def _member_at(source, buffer: bytes, start: int, at: int) -> tuple[bytes, int] | None:
    """Content and length of the gzip member at buffer[at:], if it holds a record; the file goes on after the buffer."""
    unpack = zlib.decompressobj(31)
    parts, known, taken, place = [], b"", 0, at
    try:
        while not unpack.eof:
            piece = buffer[place:place + _PIECE] or source.read_at(_PIECE, start + place)
            if not piece:
                return None
            place += len(piece)
            taken += len(piece)
            parts.append(unpack.decompress(piece))
            if len(known) < 5:
                known += parts[-1][:5]
                if not b"WARC/".startswith(known[:5]):
                    return None
    except zlib.error:
        return None
    content = b"".join(parts)
    return (content, taken - len(unpack.unused_data)) if content.startswith(b"WARC/1.") else None


def records_in(source, start: int, end: int) -> Iterator[bytes]:
    """Records of a file that start in its bytes from `start` up to `end`."""
    buffer = source.read_at(end - start + len(_MAGIC) - 1, start)
    at = buffer.find(_MAGIC)
    while 0 <= at < end - start:
        found = _member_at(source, buffer, start, at)
        if found:
            yield found[0]
        at = buffer.find(_MAGIC, at + (found[1] if found else 1))


def first_pages(pages: DataFrame, digest: str, size: str, page_id: str, least: int = REVISIT_BYTES) -> DataFrame:
    """Digests that occur more than once, with the smallest page_id; sizes below `least` are left out."""
    return (pages.where(F.col(size) >= least).groupBy(F.col(digest).alias("same"))
            .agg(F.min(page_id).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                   least: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record for each row; gives the manifest: file, bytes, records.

    Of equal payloads of at least `least` bytes the row with the smallest
    page_id is the response and the others revisit it. A null html is an empty
    payload; a null id never is the smallest, unless all are null: then all
    are responses, as are repeated rows of the smallest id. Control characters
    of a url are percent-encoded.
    """
    body: Column = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), body.alias("body"))
    rows = rows.withColumn("digest", F.sha1("body"))
    # a table of its own: where it is small Spark sees that and broadcasts it, and the pages stay where they are
    firsts = cut_lineage(
        first_pages(rows.withColumn("size", F.octet_length("body")), "digest", "size", "page_id", least), "firsts")
    rows = rows.join(firsts, F.col("digest") == F.col("same"), "left").select(
        "page_id", "url", "body", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    if least > 0:
        rows = rows.withColumn("refers_to", F.when(F.octet_length("body") >= least, F.col("refers_to")))
    folder = new_folder(pages.sparkSession, "warc")
    schema = "file string, bytes bigint, records bigint"
    small_batches(pages.sparkSession)

    def run(batches):
        out, row, done = None, [], []
        for batch in batches:
            for page, address, data, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    row = [new_file(folder, ".warc.gz"), 0, 0]
                    out = open_output(row[0])
                packed = member(record(page, address, data, other))
                out.write(packed)
                row[1] += len(packed)
                row[2] += 1
                if row[1] >= file_bytes:
                    out.close()
                    done.append(row)
                    out = None
        if out is not None:
            out.close()
            done.append(row)
        if done:
            yield rows_batch(done, arrow_schema(schema))

    return cut_lineage(rows.mapInArrow(run, schema), "manifest")


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, and the payload if asked for.

    `manifest` needs file and bytes. Each byte range of `split_bytes` is a
    task's work of its own, so large files are read by many tasks.
    """
    ranges = manifest.where("bytes > 0").select("file", "bytes", F.explode(
        F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(split_bytes).cast("bigint"))).alias("start"))
    ranges = ranges.select("file", "start", F.least("bytes", F.col("start") + split_bytes).alias("end"))
    spark = manifest.sparkSession
    # dealt by a hash of the range, so a task that runs again has the same ranges
    ranges = ranges.repartition(max(spark.sparkContext.defaultParallelism * 4, 1), "file", "start")
    schema = ("page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
              "url string" + ", payload binary" * payloads)
    kinds = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for file, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open_input(file) as source:
                    held = []
                    for data in records_in(source, start, end):
                        page, url, kind, other, payload, count, digest = parse(data)
                        held.append((page, count, digest, kind, other, url, *[payload] * payloads))
                if held:
                    yield rows_batch(held, kinds)

    return ranges.mapInArrow(run, schema)
