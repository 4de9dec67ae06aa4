"""WARC archives with an index first, read back by coalesced byte ranges.

Each task writes its rows into archives of bounded size in a folder all executors share, one gzip member a record, and
returns the index: path, offset, length, url and digest of each record. Archive names are new for each attempt of a
task and only a finished attempt's index rows exist, so a repeated task leaves nothing that is read. Reading takes an
index (all of it, or any selection), sorts it by path and offset, and joins ranges that lie close into one read.

Of records with equal payloads the one with the largest page_id is the response, the others are revisits without the
payload. A null html counts as empty; a null url gives no target header; a null page_id comes before all others, and
records with none but null ids are all responses. Repeated rows with the largest id are all responses. Other columns
are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binforge.llm.common import BROADCAST_ROWS, pieces_of, shared_dir, stage, to_release

ARCHIVE_BYTES = 256 << 20
#: Records are read together if at most this many bytes lie between them, up to so many bytes in all.
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
BLOCK_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string())])


def with_types(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, payload_bytes, sha1 and refers_to (null for responses)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    last = rows.groupBy(F.col("sha1").alias("_sha"), F.col("payload_bytes").alias("_bytes")).agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n"))
    last = stage(last.where("_n > 1 and _last is not null").drop("_n"), "payloads")  # a row for each payload that several pages have
    last = F.broadcast(last) if last.count() <= BROADCAST_ROWS else last  # else Spark splits what many rows share
    rows = rows.join(last, (F.col("sha1") == F.col("_sha")) & (F.col("payload_bytes") == F.col("_bytes")), "left")
    revisit = (F.col("payload_bytes") >= least_bytes) & F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    return rows.withColumn("refers_to", F.when(revisit, F.col("_last"))).drop("_sha", "_bytes", "_last")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~' + chr(39))}"] if url is not None else []), f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"] if revisit else []),
        *([f"X-Page: {page_id}"] if page_id is not None else []), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields (lower case), the HTTP head, and the payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    return fields, http, payload


def write(pages: DataFrame, root: str, *, most_bytes: int = ARCHIVE_BYTES, level: int = 4) -> DataFrame:
    """Write rows of ``with_types`` as archives under ``root``; returns their index, a stored table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(root)
        out, path, at = None, "", 0
        for batch in pieces_of(batches, "html"):
            rows = []
            for page, url, html, sha1, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "sha1", "refers_to"))):
                if out is None or at >= most_bytes:
                    if out is not None:
                        out.close()
                    path, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(path, compression=None)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                z = zlib.compressobj(level, wbits=31)
                data = z.compress(record(page, url, html.encode(), digest, refers)) + z.flush()
                out.write(data)
                rows.append((path, at, len(data), page, url, digest))
                at += len(data)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _INDEX)], schema=_INDEX)
        if out is not None:
            out.close()

    from pyarrow import fs

    system, folder = fs.FileSystem.from_uri(root)
    system.create_dir(folder, recursive=True)
    return stage(pages.mapInArrow(run, "path string, offset long, length long, page_id long, url string, digest string"), "warc-index")


def read(index: DataFrame, root: str, *, gap: int = GAP_BYTES, most: int = READ_BYTES) -> DataFrame:
    """The records that the rows of ``index`` name: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload."""
    kinds = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    names = [x.split()[0] for x in kinds.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, int, int]]]:
        now: list[tuple[str, int, int]] = []
        for batch in batches:
            for x in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length"))):
                if now and (x[0] != now[-1][0] or x[1] > now[-1][1] + now[-1][2] + gap or x[1] + x[2] - now[0][1] > most):
                    yield now
                    now = []
                now.append(x)
        if now:
            yield now

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(root)
        for ranges in runs(batches):
            first = ranges[0][1]
            with system.open_input_file(ranges[0][0]) as archive:
                data = archive.read_at(max(o + n for _, o, n in ranges) - first, first)
            rows = []
            for _, offset, length in ranges:
                fields, http, payload = parse(zlib.decompress(data[offset - first : offset - first + length], wbits=31))
                size, digest = int(http.rpartition(b"Content-Length: ")[2]), fields["warc-payload-digest"].removeprefix("sha1:")
                if fields["warc-type"] == "response":
                    size, own = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if own != digest:
                        raise ValueError(f"{fields['warc-record-id']}: payload digest {own}, header says {digest}")
                number = [int(fields[k]) if k in fields else None for k in ("x-page", "x-refers-to-page")]
                rows.append((number[0], fields.get("warc-target-uri"), fields["warc-type"], number[1], size, digest, payload))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

    block = F.floor(F.col("offset") / BLOCK_BYTES)
    return index.repartition("path", block).sortWithinPartitions("path", "offset").mapInArrow(run, kinds)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = to_release(f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    index = write(with_types(spark.read.parquet(f"{sf_dir}/pages.parquet")), root)
    return read(index, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
