"""WARC archives: one gzip stream written, normalised to a member for each record, indexed and read back.

1. Each task writes the records of its rows to one archive, a single gzip stream, as crawlers that
   compress whole files do. Rows with equal payloads of at least LEAST_SHARED bytes share one
   response: that of the smallest page_id; the others are revisit records without payload.
2. The normaliser inflates such a stream once, writes every record as a gzip member of its own and a
   sidecar index (offset, length, record id).
3. The reader takes the index, seeks to each member, parses the record alone and hashes the payload it
   read; a response whose payload isn't what its header says is an error. A revisit has no payload, so
   its length and digest are those of its header.

Files are in the mounted shared folder. Each attempt of a task writes files of its own and renames them
into place when whole; all attempts write the same bytes, so it doesn't matter which comes last. The
driver removes the streams when all archives stand. Only digests are shuffled to find equal payloads; the table of
shared digests is broadcast if it has at most BROADCAST_ROWS rows, else joined by a shuffle.

Defined cases: a null html is an empty payload; a null url leaves the target out; a null page_id is
never the smallest unless all of its group are null, which are responses all; rows that repeat the
smallest page_id with the same payload are responses each; payloads of any length are written whole;
columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import os
import shutil
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.llm.common import materialise, mounted_dir

LEAST_SHARED, BROADCAST_ROWS, LEVEL = 100, 1_000_000, 1
DATE = "1970-01-01T00:00:00Z"


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to of each row."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    shared = rows.where(F.octet_length("payload") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = materialise(shared.where("n > 1 AND first IS NOT NULL").select("digest", "first"), "shared-payloads")
    if shared.count() <= BROADCAST_ROWS:
        shared = F.broadcast(shared)
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(shared, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def record(number: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The bytes of one record. Control characters and blanks of the url are percent-encoded."""
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:xylem:{number}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    if page_id is not None:
        fields.append(("X-Page-Id", page_id))
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-Id", refers_to)]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", len(payload)), ("Content-Type", "application/http; msgtype=response")]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    fields.append(("Content-Length", len(block)))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and whole bytes of each record of an inflated stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        head, fields = [line], {}
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        while (line := stream.readline()).strip():
            head.append(line)
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(n := int(fields["content-length"]))
        if len(block) < n:
            raise ValueError("the archive ends within a record")
        yield fields, b"".join(head) + b"\r\n" + block + b"\r\n\r\n"


def normalise(source: str, target: str) -> int:
    """Inflate `source` once; write each record as its own member to `target` and the index beside it."""
    offset, count, own = 0, 0, uuid.uuid4().hex
    with gzip.open(source, "rb") as stream, open(f"{target}.{own}", "wb") as out, open(f"{target}.idx.{own}", "w") as index:
        for fields, whole in parsed(stream):
            member = gzip.compress(whole, LEVEL, mtime=0)
            out.write(member)
            index.write(f"{offset}\t{len(member)}\t{fields['warc-record-id']}\n")
            offset, count = offset + len(member), count + 1
    os.replace(f"{target}.idx.{own}", f"{target}.idx")
    os.replace(f"{target}.{own}", target)
    return count


def read_records(archive: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and payload of each record, each member inflated alone from its place in the index."""
    with open(archive, "rb") as f, open(f"{archive}.idx") as index:
        for line in index:
            offset, length, number = line.rstrip("\n").split("\t")
            f.seek(int(offset))
            fields, whole = next(parsed(io.BytesIO(zlib.decompress(f.read(int(length)), 31))))
            if fields["warc-record-id"] != number:
                raise ValueError(f"{archive}: the index names {number} at {offset}")
            block = whole.split(b"\r\n\r\n", 1)[1]
            yield fields, block.split(b"\r\n\r\n", 1)[1][:-4]


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write planned rows, one single-stream archive a task, below `folder`/streams; (path, records)."""
    os.makedirs(f"{folder}/streams", exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        path, count = f"{folder}/streams/pages-{part:06d}.warc.gz", 0
        own = f"{path}.{uuid.uuid4().hex}"
        with gzip.GzipFile(own, "wb", compresslevel=LEVEL, mtime=0) as out:
            for batch in batches:
                columns = [batch.column(k) for k in range(5)]
                for k in range(batch.num_rows):
                    page_id, url, payload, digest, refers_to = (c[k].as_py() for c in columns)
                    out.write(record(f"{part}:{count}", page_id, url, payload, digest, refers_to))
                    count += 1
        if count:
            os.replace(own, path)
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([count], pa.int64())})
        else:
            os.remove(own)

    return rows.mapInArrow(run, "path string, records long")


def _spread(archives: DataFrame) -> DataFrame:
    """One partition for each archive."""
    return archives.repartition(max(1, archives.count()))


def normalised(archives: DataFrame) -> DataFrame:
    """(path, records) of the archives rewritten with a member for each record, beside the folder of the streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = path.replace("/streams/", "/")
                if normalise(path, target) != records:
                    raise ValueError(f"{path}: {records} records were written")
                yield pa.RecordBatch.from_pydict({"path": [target], "records": pa.array([records], pa.int64())})

    return _spread(archives).mapInArrow(run, "path string, records long")


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for f, payload in read_records(path):
                    size, digest = int(f["x-payload-length"]), f["warc-payload-digest"].removeprefix("sha256:")
                    if f["warc-type"] == "response":
                        read = len(payload), hashlib.sha256(payload).hexdigest()
                        if read != (size, digest):
                            raise ValueError(f"{path}: the payload of {f['warc-record-id']} isn't what its header says")
                        size, digest = read
                    rows.append((number(f.get("x-page-id")), size, digest, f["warc-type"], number(f.get("x-refers-to-page-id"))))
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return _spread(archives).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame) -> DataFrame:
    """Write, normalise and read back the archives of pages."""
    folder = mounted_dir(pages.sparkSession, "warc")
    streams = materialise(write_archives(planned(pages), folder), "warc-streams")
    archives = materialise(normalised(streams), "warc-archives")
    shutil.rmtree(f"{folder}/streams")
    return read_archives(archives)


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1 HAVING count(*) > 1 AND min(page_id) IS NOT NULL)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN first END AS refers_to FROM p LEFT JOIN f USING (payload_digest)
"""
