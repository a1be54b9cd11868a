"""WARC archives: a distributed writer with revisit records and a sequential reader.

Every record is a gzip member of its own. The reader takes archives as a stream: it inflates piece by piece, frames a
record by its Content-Length, and checks the payload against its digest, so memory is bounded by one record.

Of pages with equal payloads of at least `least` bytes, the one with the largest id is a response and the others are
revisits that refer to it; smaller payloads are always responses. Null payloads count as empty, null urls as urn:none.
Repeated rows of one id are a record each, and all of the same kind. A null id is a revisit of the largest id that is not
null, or a response where there is none; its record has an id of its own, while those of repeated ids share theirs. Columns other than id, url and payload are not read. A task that is tried again
writes its archives anew under another name; only the names that finished tasks return are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import at_most, materialize, new_folder

ARCHIVE_BYTES = 256 << 20
#: Digests that several pages hold are broadcast up to this count, else shuffled.
BROADCAST_ROWS = 500_000
CHUNK = 1 << 20
RECORD_SCHEMA = "archive string, record_id string, warc_type string, target_uri string, refers_to string, payload_digest string, payload_bytes bigint, payload binary, digest_ok boolean"


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes
    digest_ok: bool | None


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    """One record as one gzip member."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def _http(payload: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def inflated(stream) -> Iterator[Iterator[bytes]]:  # noqa: ANN001
    """For each gzip member of a stream, an iterator over its inflated pieces."""
    rest = b""
    while True:
        rest = rest or stream.read(CHUNK)
        if not rest:
            return

        def pieces() -> Iterator[bytes]:
            nonlocal rest
            inflate = zlib.decompressobj(31)
            while not inflate.eof:
                data = rest or stream.read(CHUNK)
                rest = b""
                if not data:
                    raise ValueError("the archive ends inside a record")
                while data and not inflate.eof:
                    if piece := inflate.decompress(data, CHUNK):
                        yield piece
                    data = inflate.unconsumed_tail
                rest = inflate.unused_data

        yield pieces()


def records(stream) -> Iterator[Record]:  # noqa: ANN001
    """The records of an archive, in order."""
    for pieces in inflated(stream):
        buffer = bytearray()
        for piece in pieces:
            buffer += piece
            if (end := buffer.find(b"\r\n\r\n")) >= 0:
                break
        else:
            raise ValueError("a record without a header")
        version, *lines = bytes(buffer[:end]).decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:20]}")
        headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        del buffer[: end + 4]
        for piece in pieces:
            buffer += piece
        length = int(headers["content-length"])
        if len(buffer) != length + 4 or buffer[length:] != b"\r\n\r\n":
            raise ValueError("a record's length is not as stated")
        block = bytes(buffer[:length])
        payload = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
        stated = headers.get("warc-payload-digest", "").removeprefix("sha1:")
        ok = digest_of(payload) == stated if stated and headers["warc-type"] != "revisit" else None
        yield Record(headers, payload, ok)


def _opened(path: str):  # noqa: ANN202
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def assign_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload (binary), sha1 (hex), refers_to (null for responses)."""
    own = pages.select(F.col("page_id").cast("long"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    own = own.withColumn("sha1", F.sha1("payload"))
    large = F.octet_length("payload") >= least
    # payloads stay where they are: only the digests that several pages hold are sent to them
    groups = own.filter(large).groupBy("sha1").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).filter("n > 1 and newest is not null").drop("n")
    groups = at_most(materialize(groups), BROADCAST_ROWS)
    refers = F.when(large & ~F.col("page_id").eqNullSafe(F.col("newest")), F.col("newest"))
    return own.join(groups, "sha1", "left").select("page_id", "url", "payload", "sha1", refers.alias("refers_to"))


def write(assigned: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write archives into a folder that executors share; returns archive and n_records, a row for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, root = _opened(folder)
        files.create_dir(root, recursive=True)
        out, name, n, size = None, "", 0, 0
        made: list[tuple[str, int]] = []
        date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

        def closed() -> None:
            if out is not None:
                out.close()
                made.append((f"{folder}/{name}", n))

        for batch in batches:
            for i in range(batch.num_rows):
                if out is None or size >= archive_bytes:
                    closed()
                    name, n, size = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(member("warcinfo", {"WARC-Date": date, "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
                page_id, url, payload, sha1, refers_to = (batch.column(j)[i].as_py() for j in range(5))
                headers = {
                    "WARC-Date": date, "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>" if page_id is None else f"<urn:page:{page_id}>", "WARC-Target-URI": (url or "urn:none").replace("\r", "").replace("\n", ""),
                    "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode(), "Content-Type": "application/http; msgtype=response",
                }
                if refers_to is None:
                    data = member("response", headers, _http(payload))
                else:
                    headers |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Payload-Length": str(len(payload))}
                    data = member("revisit", headers, b"HTTP/1.1 200 OK\r\n\r\n")
                out.write(data)
                n, size = n + 1, size + len(data)
        closed()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made]), pa.array([m[1] for m in made], pa.int64())], ["archive", "n_records"])

    return assigned.select("page_id", "url", "payload", "sha1", "refers_to").mapInArrow(run, "archive string, n_records bigint")


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of archives (column `archive`: paths), RECORD_SCHEMA; a wrong digest shows in digest_ok, null without one.

    payloads=False leaves the payload null once it is checked.
    """
    names = [part.split()[0] for part in RECORD_SCHEMA.split(", ")]
    types = [pa.string()] * 6 + [pa.int64(), pa.binary(), pa.bool_()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, at = _opened(path)
                rows, size = [], 0
                with files.open_input_stream(at, compression=None) as stream:
                    for r in records(stream):
                        h = r.headers
                        n = int(h.get("x-payload-length", len(r.payload)))
                        rows.append((path, h.get("warc-record-id"), h["warc-type"], h.get("warc-target-uri"), h.get("warc-refers-to"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None, n, r.payload if payloads else None, r.digest_ok))
                        size += len(r.payload) if payloads else 200
                        if size >= 8 * CHUNK:
                            yield batch_of(rows)
                            rows, size = [], 0
                yield batch_of(rows)

    return archives.select("archive").mapInArrow(run, RECORD_SCHEMA)


def _page(record_id: str):  # noqa: ANN202
    return F.regexp_extract(record_id, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages as records, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A record whose payload does not match its digest stops the job.
    """
    archives = materialize(write(assign_revisits(pages, least), new_folder(spark, "warc")))
    # one archive to a task; there is a row for each ARCHIVE_BYTES
    numbered = archives.withColumn("no", F.row_number().over(Window.orderBy("archive")) - 1)
    archives = numbered.repartitionById(max(1, archives.count()), "no")
    found = read(archives, payloads=False).filter(F.col("warc_type").isin("response", "revisit"))
    checked = F.when(F.col("digest_ok") == F.lit(False), F.raise_error(F.lit("a payload does not match its digest"))).otherwise(F.col("payload_digest"))
    return found.select(_page("record_id").alias("page_id"), "payload_bytes", checked.cast("string").alias("payload_digest"), F.col("warc_type").alias("record_type"), _page("refers_to").alias("refers_to"))
