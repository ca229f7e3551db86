"""WARC archives: a writer with revisit records, and a reader that splits files.

Archives are gzip files with one member per record. A reading task gets a byte range: it
looks for gzip magic, takes a candidate for a member if it decodes (checksum included) to
a WARC header, and owns the records that start in its range, reading past the end for the
last one. A record inside another's payload is none: where nothing tells (no member before
it, none after it), the file is read back for one that encloses it. Damaged members are
passed over, their neighbours kept, and ``unread`` tells how many bytes that was. Files are opened through Arrow's file
systems, by the address of the folder, local or remote.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concilia.session import shared_folder

from .common import partitions, staged, text_or_empty

MAGIC = b"\x1f\x8b\x08"
_CHUNK = 1 << 20
_END = b"\r\n\r\n"
_CONTROL = re.compile(r"[\x00-\x20\x7f]+")
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 SHA-1: each five hex digits are four digits of base 32."""
    digest = F.sha1(data)
    digits = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A record as one gzip member; a revisit has the response's HTTP head and no payload."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:x-page:{page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_CONTROL.sub('%20', url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:x-page:{refers_to}>",
        ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + _END + block + _END) + packer.flush()


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_revisit_bytes: int = 0,
    archive_bytes: int = 1 << 28,
    date: str = "2000-01-01T00:00:00Z",
) -> DataFrame:
    """Writes a record per row to ``folder`` and returns the written ``path, bytes, records``.

    Of the rows with equal payloads of at least ``min_revisit_bytes`` the one with the
    largest id is a response and the others revisit it. A null html is an empty payload, a
    null id is smaller than any other; rows that repeat the response's id and payload are
    responses too, as are all where no id is known. Only digests that occur more than once
    are joined, so a payload that a third of all rows share is never gathered. Tasks write
    files of new names and report them when closed: what a lost or repeated task left
    behind is in no manifest.
    """
    payload = F.encode(text_or_empty(html_col), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload")))
    shared = rows.where(F.length("payload") >= min_revisit_bytes).groupBy("digest").agg(
        F.max("page_id").alias("latest"), F.count("*").alias("n")
    )
    shared = staged(shared.where(F.col("n") > 1).select("digest", "latest"), "digests")
    rows = rows.join(shared, "digest", "left")
    revisit = F.col("latest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("latest"))
    rows = rows.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("latest")).alias("refers_to"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        name, out, count, done = "", None, 0, []

        def close() -> None:
            done.append((f"{folder}/{name}", out.tell(), count))
            out.close()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, count = system.open_output_stream(f"{base}/{name}", compression=None), 0
                out.write(_record(*row, date))
                count += 1
                if out.tell() >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        columns = zip(*done) if done else [()] * 3
        arrays = [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["path", "bytes", "records"])

    return staged(rows.mapInArrow(each, "path string, bytes long, records long"), "manifest")


class _Range:
    """Reads members of a file from a byte range on."""

    def __init__(self, file: pa.NativeFile, size: int, start: int, end: int):
        self.file, self.size, self.start = file, size, start
        self.data = file.read_at(min(size, end + _CHUNK) - start, start)

    def _need(self, upto: int) -> bool:
        """Reads on until the byte before ``upto`` is there."""
        while self.start + len(self.data) < min(upto, self.size):
            at = self.start + len(self.data)
            more = self.file.read_at(min(_CHUNK, self.size - at), at)
            if not more:
                raise EOFError(f"the file ends at {at}, not at {self.size}")
            self.data += more
        return upto <= self.size

    def magic(self, at: int) -> bool:
        return self._need(at + 3) and self.data[at - self.start : at - self.start + 3] == MAGIC

    def find(self, at: int, end: int) -> int:
        """The first magic that starts in [at, end), or -1."""
        self._need(min(end + 2, self.size))
        found = self.data.find(MAGIC, at - self.start, min(end, self.size) - self.start + 2)
        return found + self.start if found >= 0 else -1

    def member(self, at: int) -> tuple[bytes, int, bool] | None:
        """The content of the member at ``at``, where it ends, and whether a member or the
        file's end follows; None if there is none, or it is damaged."""
        unpacker, out, position, size = zlib.decompressobj(31), [], at, 1 << 14
        try:
            while not unpacker.eof:
                if not self._need(position + 1):
                    return None
                piece = self.data[position - self.start : position - self.start + size]
                position += len(piece)
                out.append(unpacker.decompress(piece))
                if len(out) == 1 and not out[0].startswith(b"WARC/1."[: len(out[0])]):
                    return None
        except zlib.error:
            return None
        content = b"".join(out)
        end = position - len(unpacker.unused_data)
        return (content, end, end == self.size or self.magic(end)) if content.startswith(b"WARC/1.") else None


def _enclosed(file: pa.NativeFile, size: int, place: int) -> bool:
    """Whether a member that starts before ``place`` reaches beyond it."""
    for start in range((place - 1) // _CHUNK * _CHUNK, -1, -_CHUNK):
        end = min(start + _CHUNK, place)
        reader, at = _Range(file, size, start, end), start
        while (at := reader.find(at, end)) >= 0:
            found = reader.member(at)
            if found and found[1] > place:
                return True
            at += 1
    return False


def records_in(file: pa.NativeFile, size: int, start: int, end: int) -> Iterator[tuple[int, int, bytes]]:
    """``(offset, length, content)`` of the records that start in the byte range [start, end)."""
    reader, at, known = _Range(file, size, start, end), start, 0
    while (at := reader.find(at, end)) >= 0:
        found = reader.member(at)
        # A member right after another, or with one after it, stands by itself.
        if found is None or not (found[2] or at == known or not _enclosed(file, size, at)):
            at += 1
            continue
        yield at, found[1] - at, found[0]
        at = known = found[1]
        if at >= end:
            return


def parsed(content: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (lower-case names) and payload of a record."""
    head, _, rest = content.partition(_END)
    headers = _headers(head)
    block = rest[: int(headers.get("content-length", len(rest)))]
    if not block.startswith(b"HTTP/"):
        return headers, {}, block
    http, _, payload = block.partition(_END)
    return headers, _headers(http), payload


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def read_archives(manifest: DataFrame, split_bytes: int = 1 << 24) -> DataFrame:
    """``path, offset, length, headers, http, payload`` of every record of the listed archives.

    ``manifest`` has ``path, bytes``; ``length`` counts the record's bytes in the file. Files are cut into ranges of ``split_bytes``, so one
    large archive is read by many tasks; a task holds one range and one record. A range in
    which no record starts, and an empty list, yield nothing.
    """
    ranges = manifest.where("bytes > 0").select(
        "path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start")
    ).repartition(partitions(manifest.sparkSession))
    kinds = pa.map_(pa.string(), pa.string())
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("headers", kinds), ("http", kinds), ("payload", pa.binary())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                system, name = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with system.open_input_file(name) as file:
                    for offset, length, content in records_in(file, size, start, min(size, start + split_bytes)):
                        headers, http, payload = parsed(content)
                        rows.append((path, offset, length, list(headers.items()), list(http.items()), payload))
                        held += len(content)
                        if held > 4 * _CHUNK:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return ranges.mapInArrow(each, "path string, offset long, length long, headers map<string,string>, http map<string,string>, payload binary")


def unread(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """``path, bytes, n_records, unread_bytes`` per listed archive: what ``read_archives`` gave,
    and the bytes that belong to no record it could read (0 for a sound file)."""
    read = records.groupBy("path").agg(F.sum("length").alias("read"), F.count("*").alias("n"))
    nothing = F.lit(0).cast("long")
    return manifest.join(read, "path", "left").select(
        "path", "bytes", F.coalesce("n", nothing).alias("n_records"), (F.col("bytes") - F.coalesce("read", nothing)).alias("unread_bytes")
    )


def archived_pages(pages: DataFrame, min_revisit_bytes: int = 0, split_bytes: int = 1 << 24, **columns) -> DataFrame:
    """Writes ``pages`` below the shared folder, reads the archives back, and returns
    ``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` per record.

    Sizes and digests of responses are those of the payloads read; revisits have them from
    their headers. An empty table yields an empty result.
    """
    folder = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    read = read_archives(write_archives(pages, folder, min_revisit_bytes=min_revisit_bytes, **columns), split_bytes)
    header = lambda name: F.element_at("headers", name)
    page = lambda name: F.regexp_extract(header(name), r"<urn:x-page:(-?\d+)>", 1).try_cast("long")
    full = header("warc-type") == "response"
    return read.select(
        page("warc-record-id").alias("page_id"),
        header("warc-target-uri").alias("url"),
        F.when(full, F.length("payload")).otherwise(F.element_at("http", "content-length")).cast("long").alias("payload_bytes"),
        F.when(full, base32_sha1(F.col("payload"))).otherwise(F.substring_index(header("warc-payload-digest"), ":", -1)).alias("payload_digest"),
        header("warc-type").alias("record_type"),
        page("warc-refers-to").alias("refers_to"),
    )


def sql(table: str) -> str:
    """The record kinds and digests for a second engine."""
    digits = ", ".join(f"'{_BASE32}'[((v >> {shift}) & 31) + 1]" for shift in (15, 10, 5, 0))
    return f"""
with p as (select page_id, octet_length(encode(coalesce(html, ''))) payload_bytes, sha1(coalesce(html, '')) hex from {table}),
d as (select page_id, payload_bytes, hex, array_to_string(list_transform(
    list_transform(range(8), lambda i: ('0x' || substr(hex, i * 5 + 1, 5))::int), lambda v: concat({digits})), '') payload_digest,
    max(page_id) over (partition by hex) latest from p)
select page_id, payload_bytes, payload_digest, case when page_id = latest then 'response' else 'revisit' end record_type,
    case when page_id <> latest then latest end refers_to from d"""
