"""WARC archives: a writer that deduplicates payloads by digest, and a sequential reader.

Writing: of the records with equal payloads of at least ``REVISIT_BYTES`` bytes the one with the largest page_id is a
response, the others are revisits, which hold the response's headers only. Each record is a gzip member of its own. A
task writes one file; it appears under its final name when it is complete, so a repeated task replaces it by the same.

Reading: a file is read in small pieces, each gzip member is decompressed incrementally, its record is framed by
Content-Length, and block and payload digests are verified; at any time one record is held.

The pages move once, to be joined with the digests that occur more than once. These are aggregated before they are
shuffled, and both sides carry a salt, so that copies of one payload are spread over ``SALT`` tasks.

A null html is an empty payload. A null page_id comes back as null; it is largest only if all ids are null, and then
all records are responses, as are repeated rows of the largest id. Null urls get no target header. Empty tables give
empty archives. Only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

REVISIT_BYTES = 1000
SALT = 16
PIECE = 1 << 16
LEVEL = 3
URN = "urn:stratalog:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def sha1_32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record; of a revisit the block ends with the HTTP headers."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%~"))
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    lines += [f"WARC-Payload-Digest: {sha1_32(payload)}", f"WARC-Block-Digest: {sha1_32(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Damaged(ValueError):
    """An archive that breaks the format or a digest."""


def split(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a compressed stream, one record in memory."""
    left, done = b"", False
    while True:
        z, head, rest, want, headers, begun = zlib.decompressobj(31), bytearray(), bytearray(), -1, {}, False
        while not z.eof:
            if not left and not done:
                left = stream.read(PIECE)
                done = not left
            if not left:
                if begun:
                    raise Damaged("the archive ends within a member")
                return
            begun = True
            out = z.decompress(left)
            left = z.unused_data if z.eof else z.unconsumed_tail
            if want < 0:
                head += out
                at = head.find(b"\r\n\r\n")
                if at >= 0:
                    lines = head[:at].decode("utf-8").split("\r\n")
                    if not lines[0].startswith("WARC/"):
                        raise Damaged("no WARC version line")
                    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                    want = int(headers["content-length"])
                    rest += head[at + 4 :]
            else:
                rest += out
            if want >= 0 and len(rest) > want + 4:
                raise Damaged("a member holds more than its record")
        if want < 0 or len(rest) != want + 4 or rest[want:] != b"\r\n\r\n":
            raise Damaged("a record's length differs from its Content-Length")
        yield headers, bytes(memoryview(rest)[:want])


def digest_is(data: bytes, stated: str) -> bool:
    kind, _, value = stated.partition(":")
    h = hashlib.new(kind, data)
    return value.upper() == base64.b32encode(h.digest()).decode() or value.lower() == h.hexdigest()


def parsed(headers: dict[str, str], block: bytes) -> tuple:
    """page_id, url, type, refers_to, payload bytes, payload digest as hex, payload (None for a revisit)."""
    if not digest_is(block, headers["warc-block-digest"]):
        raise Damaged("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    revisit = headers["warc-type"] == "revisit"
    if not revisit and (len(payload) != size or not digest_is(payload, headers["warc-payload-digest"])):
        raise Damaged("payload digest differs")
    value = headers["warc-payload-digest"].partition(":")[2]
    digest = value.lower() if len(value) == 40 else base64.b32decode(value).hex()
    number = lambda x: int(x) if (x := x.strip("<>").removeprefix(URN)) else None
    return number(headers["warc-record-id"]), headers.get("warc-target-uri"), headers["warc-type"], number(headers["warc-refers-to"]) if revisit else None, size, digest, None if revisit else payload


def write_warc(pages: DataFrame, where: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z", least: int = REVISIT_BYTES) -> DataFrame:
    """Write the archives to the folder where (a URI); returns (path, records, bytes), a row a file."""
    common.tuned(pages.sparkSession)
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    source = source.withColumn("digest", F.when(F.octet_length("payload") >= least, F.sha1("payload"))).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int"))
    many = source.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    many = many.select("digest", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"), "first")
    # short payloads have no digest here; they spread by page_id instead of meeting in one task
    key = F.coalesce("digest", F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    joined = source.withColumn("digest", key).join(many.hint("shuffle_merge"), ["digest", "salt"], "left").select("page_id", "url", "payload", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(where)
        fs.create_dir(folder, recursive=True)
        task = TaskContext.get()
        final = f"{folder}/part-{task.partitionId():06d}.warc.gz"
        partial = f"{folder}/.{task.taskAttemptId()}-{task.partitionId():06d}"
        n = size = 0
        with fs.open_output_stream(partial, compression=None) as out:
            for batch in batches:
                for page_id, url, payload, first in zip(*(c.to_pylist() for c in batch.columns)):
                    data = member(record(page_id, url, payload, first, first is not None and first != page_id, date))
                    out.write(data)
                    n, size = n + 1, size + len(data)
        fs.move(partial, final)
        yield pa.RecordBatch.from_arrays([pa.array([final]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

    return common.written(joined.mapInArrow(run, "path string, records long, bytes long"), "op7-files")


def read_warc(files: DataFrame, where: str, payloads: bool = True) -> DataFrame:
    """The records of the archives named in files (column path), in RECORDS' columns; a damaged archive raises."""
    spark = common.tuned(files.sparkSession)
    n = files.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(where)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for headers, block in split(stream):
                        row = parsed(headers, block)
                        rows.append(row if payloads else (*row[:-1], None))
                        size += row[4] if payloads else 0
                        if size > 1 << 22 or len(rows) >= 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)

    return files.select("path").repartition(max(1, min(n, 4 * spark.sparkContext.defaultParallelism)), "path").mapInArrow(run, RECORDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = common.new_path(spark, "warc")
    files = write_warc(common.table(spark, sf_dir, "pages"), where)
    return read_warc(files, where, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d FROM p),
m AS (SELECT d, max(page_id) AS first FROM q WHERE n >= 1000 GROUP BY d)
SELECT q.page_id, CAST(n AS BIGINT) AS payload_bytes, q.d AS payload_digest,
  CASE WHEN m.first IS NULL OR m.first = q.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN m.first <> q.page_id THEN m.first END AS refers_to
FROM q LEFT JOIN m ON q.n >= 1000 AND q.d = m.d
"""
