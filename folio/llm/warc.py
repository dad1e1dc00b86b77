"""WARC archives written and read as a chunked record table."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, stored, wide, with_group

CHUNK_BYTES = 1 << 20
#: Compressed bytes after which the writer ends a segment; a segment is what one reading task takes at least.
SEGMENT_BYTES = 4 << 20
#: Bytes of chunks that a reading task holds before it hands them on.
FLUSH_BYTES = 8 << 20
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

MANIFEST = "archive string, begins long, ends long, records long"
CHUNKS = "record_id long, record_type string, refers_to long, target_uri string, declared_digest string, declared_bytes long, chunk_no long, chunk binary, bytes_so_far long, digest_so_far string, last boolean"


def chunk_records(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """records(record_id, target_uri, payload binary, …) as one row per chunk, in order: chunk_no and chunk instead of payload; an empty payload has one empty chunk."""
    rest = [c for c in records.columns if c != "payload"]
    last = F.greatest(F.lit(0), F.ceil(F.length("payload") / F.lit(chunk_bytes)).cast("int") - 1)
    numbered = records.select(*rest, "payload", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    return numbered.select(*rest, F.col("chunk_no").cast("long").alias("chunk_no"), F.substring("payload", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("chunk"))


def b32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def uri(text: str | None, record_id: int | None) -> str:
    """A header value without line ends or blanks."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text) if text else f"urn:page:{record_id}"


def head(row: dict) -> bytes:
    revisit = row["record_type"] == "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:page:{row['record_id']}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri(row['target_uri'], row['record_id'])}", f"WARC-Payload-Digest: sha1:{b32(row['sha1'])}", f"WARC-Payload-Length: {row['payload_bytes']}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{row['refers_to']}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(HTTP) + (0 if revisit else row['payload_bytes'])}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + HTTP


def _writer(folder: str, segment_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        segments, begins, records, out, member = [], 0, 0, None, None

        def ended():
            nonlocal member
            if member is not None:
                member.write(b"\r\n\r\n")
                member.close()
                member = None

        try:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i].as_py() for c in ("record_id", "record_type", "refers_to", "target_uri", "sha1", "payload_bytes", "chunk_no")}
                    if row["chunk_no"] == 0:
                        ended()
                        if out is None:
                            out = store.open_output_stream(f"{root}/{name}", compression=None)
                        if out.tell() - begins >= segment_bytes:
                            segments.append((name, begins, out.tell(), records))
                            begins, records = out.tell(), 0
                        member = gzip.GzipFile(fileobj=out, mode="wb", compresslevel=4, mtime=0)
                        member.write(head(row))
                        records += 1
                    if row["record_type"] == "response":
                        member.write(batch.column("chunk")[i].as_buffer())
            ended()
        finally:
            if out is not None:
                end = out.tell()
                out.close()
        if out is not None:
            segments.append((name, begins, end, records))
            cols = list(zip(*segments, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=["archive", "begins", "ends", "records"])

    return write


def write_warc(chunks: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Writes chunks(record_id, record_type, refers_to, target_uri, sha1, payload_bytes, chunk_no, chunk) as archives; returns the manifest, a row for each segment.

    The chunks of a record stand together and in order within a partition, as chunk_records makes them; a task holds one
    batch of chunks at a time and streams them into one gzip member per record. An archive's name is unique to the
    attempt that writes it, and only archives of the manifest, which Spark commits, are read: a lost or repeated attempt
    leaves at most a file that no one refers to. folder must be reachable by all executors (any scheme that
    pyarrow.fs opens).
    """
    return stored(chunks.mapInArrow(_writer(folder, segment_bytes), MANIFEST), "manifest")


class _Span(io.RawIOBase):
    """The bytes [begins, ends) of an open file."""

    def __init__(self, file, begins: int, ends: int):
        self.file, self.left = file, ends - begins
        file.seek(begins)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.file.read(min(len(into), self.left))
        into[: len(data)] = data
        self.left -= len(data)
        return len(data)


def read_records(stream, chunk_bytes: int) -> Iterator[tuple]:
    """The records of a gzip stream as chunk tuples in the order of CHUNKS; never more than one chunk in memory."""
    stream = io.BufferedReader(stream) if isinstance(stream, io.RawIOBase) else stream
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            key, _, value = line.decode("utf-8", "replace").partition(":")
            fields[key.strip().lower()] = value.strip()
        left = int(fields["content-length"])
        while left:
            line = stream.readline(left)
            left -= len(line)
            if line in (b"\r\n", b""):
                break
        ids = [None if (m := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(k, ""))) is None else int(m[1]) for k in ("warc-record-id", "warc-refers-to")]
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        known = (ids[0], fields["warc-type"], ids[1], fields.get("warc-target-uri"), digest, int(fields.get("warc-payload-length", -1)))
        sha, done, number = hashlib.sha1(), 0, 0
        while True:
            data = b""
            while len(data) < min(chunk_bytes, left):
                more = stream.read(min(chunk_bytes, left) - len(data))
                if not more:
                    raise EOFError("a record ends too early")
                data += more
            left -= len(data)
            sha.update(data)
            done += len(data)
            yield (*known, number, data, done, base64.b32encode(sha.digest()).decode(), left == 0)
            number += 1
            if left == 0:
                break


def _reader(folder: str, chunk_bytes: int, with_chunks: bool):
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    types = [kinds[c.split()[1]] for c in CHUNKS.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        rows, size = [], 0
        for segments in batches:
            for s in segments.to_pylist():
                with store.open_input_file(f"{root}/{s['archive']}") as file:
                    for row in read_records(gzip.GzipFile(fileobj=io.BufferedReader(_Span(file, s["begins"], s["ends"]), 1 << 18)), chunk_bytes):
                        rows.append(row if with_chunks else (*row[:7], None, *row[8:]))
                        size += 200 + (len(row[7]) if with_chunks else 0)
                        if size > FLUSH_BYTES:
                            yield batch(rows)
                            rows, size = [], 0
        if rows:
            yield batch(rows)

    return read


def read_warc(manifest: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES, with_chunks: bool = True) -> DataFrame:
    """The chunk table of the archives: one row per record and chunk number (CHUNKS).

    digest_so_far is the SHA-1 of the payload up to the chunk's end, so that the row with last has that of the whole
    payload though no task ever held it. with_chunks=False leaves the bytes out after they were digested. Segments are
    dealt over all tasks.
    """
    return wide(manifest, "archive", "begins").mapInArrow(_reader(folder, chunk_bytes, with_chunks), CHUNKS)


def page_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Records of pages(page_id, url, html): payload is the html in UTF-8 (null: empty).

    Of records with equal payloads of least_bytes or more, the one with the largest page_id is the response and the
    others revisit it. Rows that repeat page_id and payload have the same type. A null page_id loses to any other.
    A payload that is shared by a large share of the pages is decided by a broadcast (with_group), the others
    after a shuffle of narrow rows.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    records = pages.select(F.col("page_id").cast("long").alias("record_id"), F.col("url").alias("target_uri"), payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    narrow = stored(records.select("record_id", F.length("payload").alias("n"), "sha1"), "payloads")
    found = with_group(narrow.where(F.col("n") >= least_bytes), "sha1", keep=F.max("record_id"))
    revisits = found.where(~F.col("record_id").eqNullSafe(F.col("keep")) & F.col("keep").isNotNull()).select(F.col("record_id").alias("_id"), F.col("sha1").alias("_sha1"), F.col("keep").alias("refers_to")).distinct()
    known = records.join(revisits, records["record_id"].eqNullSafe(F.col("_id")) & (records["sha1"] == F.col("_sha1")), "left").drop("_id", "_sha1")
    kind = F.when(F.col("refers_to").isNull(), F.lit("response")).otherwise(F.lit("revisit"))
    return known.select("record_id", "target_uri", kind.alias("record_type"), "refers_to", "sha1", F.length("payload").cast("long").alias("payload_bytes"), "payload")


def archive_pages(pages: DataFrame, least_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, str]:
    """(manifest, folder) of archives with a record for each page; empty table: an empty manifest."""
    folder = new_path(pages.sparkSession, "warc")
    records = page_records(pages, least_bytes)
    # of a revisit only the head is written, so its payload needn't be cut
    cut = records.withColumn("payload", F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b"")))
    return write_warc(chunk_records(cut, chunk_bytes), folder), folder
