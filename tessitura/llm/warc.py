"""WARC archives from pages and back, payloads as rows of chunks.

Writing streams each record into one archive file per task, gzipped record by record. Reading
streams each archive once and gives rows of (record identifier, chunk number, bytes) with digest and length
up to and including the chunk, so no reader holds more than one chunk of a payload; the last chunk's
values are those of the whole payload.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bound_batches, checked_broadcast, qualified, scratch, written

#: Payload bytes of a chunk; payloads from which equal ones become revisits; date of the records.
CHUNK, REVISIT, DATE = 1 << 20, 1000, "2024-01-01T00:00:00Z"
#: Keys over which the pages of one payload are spread; revisits that share a copy of the response's facts; most bytes of a record's head.
SALTS, ROWS_PER_SALT, HEAD = 16, 4096, 1 << 20

CHUNK_SCHEMA = "record_id string, record_type string, page_id long, target_uri string, refers_to_id string, declared_digest string, chunk_no int, data binary, sha1 string, n_bytes long, last boolean"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record_id(page_id: int | None, digest: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}' if page_id is not None else f'payload:{digest}')}>"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path with a scheme, and the path there."""
    return fs.FileSystem.from_uri(path)


def _head(kind: str, ident: str, length: int, fields: list[tuple[str, str]]) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {ident}", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _put(out, head: bytes, parts) -> None:
    """One gzip member: the head, the block's parts, and the record's end."""
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    out.write(pack.compress(head))
    for part in parts:
        out.write(pack.compress(part))
    out.write(pack.compress(b"\r\n\r\n"))
    out.write(pack.flush())


def _writer(folder: str):
    def run(batches):
        out, path, records = None, "", 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                task = TaskContext.get()
                where, base = opened(folder)
                where.create_dir(base, recursive=True)
                # a name of its own for each attempt: only files that the manifest names are read
                name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
                path = f"{folder}/{name}"
                out = where.open_output_stream(f"{base}/{name}", compression=None)
                info = b"software: tessitura\r\nformat: WARC File Format 1.1\r\n"
                _put(out, _head("warcinfo", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, path)}>", len(info), [("Content-Type", "application/warc-fields")]), [info])
            page, url, sha1, size, keep = (batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5))
            for k in range(batch.num_rows):
                fields = [("WARC-Target-URI", quote(url[k] or "about:blank", safe=":/?#[]@!$&'()*+,;=%-._~"))]
                fields += [("X-Page-Id", str(page[k]))] if page[k] is not None else []
                fields += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1[k])).decode()), ("Content-Type", "application/http; msgtype=response")]
                ident = record_id(page[k], sha1[k])
                if keep[k] is not None:
                    fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(keep[k]))]
                    _put(out, _head("revisit", ident, len(_HTTP), fields), [_HTTP])
                else:
                    value = batch.column(2)[k]
                    body = memoryview(value.as_buffer()) if size[k] else memoryview(b"")
                    parts = (body[i : i + CHUNK] for i in range(0, size[k], CHUNK))
                    _put(out, _head("response", ident, len(_HTTP) + size[k], fields), [_HTTP, *parts] if size[k] <= CHUNK else _chain(_HTTP, parts))
                records += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64())], names=["path", "records"])

    return run


def _chain(first, rest):
    yield first
    yield from rest


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each row into archives under a folder that all executors share; returns their manifest (path, records).

    Null html is an empty payload, a null url about:blank. Of rows with equal payloads of at least
    REVISIT bytes the largest id is the response, others (null ids too) are revisits of it; without any id
    they all are responses. Rows that repeat the largest id are all responses.
    """
    bound_batches(pages.sparkSession)
    folder = qualified(pages.sparkSession, folder)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    size = F.octet_length("html").cast("long")
    facts = rows.where(size >= REVISIT).select("page_id", F.unhex(F.sha2("html", 256)).alias("sha"))
    kept = facts.groupBy("sha").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1 and keep is not null").select("sha", "keep")
    kept = written(kept, "responses")
    rows = rows.withColumn("sha", F.when(size >= REVISIT, F.unhex(F.sha2("html", 256))))
    if kept.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        met = rows.join(F.broadcast(kept), "sha", "left")
    else:  # small pages have no part in the join; a payload that many pages share is spread over SALTS keys
        spread = kept.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        large = rows.where("sha is not null").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        met = large.join(spread, ["sha", "salt"], "left").drop("salt").unionByName(rows.where("sha is null").withColumn("keep", F.lit(None).cast("long")))
    refers = F.when(F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep"))
    pages_out = met.select("page_id", "url", "html", F.sha1(F.encode("html", "UTF-8")).alias("sha1"), size.alias("n"), refers.alias("keep"))
    return written(pages_out.mapInArrow(_writer(folder), "path string, records long"), "warc-manifest")


class _Source:
    """Bytes of a gzipped archive, read and unpacked piece by piece."""

    def __init__(self, stream):
        self.stream, self.unpack, self.ready = stream, zlib.decompressobj(31), b""
        self.rest = b""

    def more(self) -> bool:
        while True:
            if not self.rest:
                self.rest = self.stream.read(1 << 16)
                if not self.rest:
                    return False
            data = self.unpack.decompress(self.rest, 1 << 18)
            self.rest = self.unpack.unconsumed_tail
            if self.unpack.eof:
                self.rest = self.unpack.unused_data
                self.unpack = zlib.decompressobj(31)
            if data:
                self.ready += data
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to a mark, which is skipped; None at the end. More than HEAD bytes without it are no archive."""
        while (at := self.ready.find(mark)) < 0:
            if len(self.ready) > HEAD:
                raise ValueError("a record's head has no end")
            if not self.more():
                return None
        out, self.ready = self.ready[:at], self.ready[at + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        """Up to n bytes, at least one unless the archive ends."""
        while len(self.ready) < n and self.more():
            pass
        out, self.ready = self.ready[:n], self.ready[n:]
        return out


def records(stream, chunk: int = CHUNK) -> Iterator[tuple]:
    """Rows of CHUNK_SCHEMA for the response and revisit records of an archive."""
    source = _Source(stream)
    while (head := source.until(b"\r\n\r\n")) is not None:
        fields = {}
        for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        left = int(fields["content-length"])
        kind = fields["warc-type"]
        if kind not in ("response", "revisit"):
            while left:
                left -= len(source.take(min(left, chunk)))
            source.take(4)
            continue
        http = source.until(b"\r\n\r\n")
        left -= len(http) + 4
        page = fields.get("x-page-id")
        declared = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        common = (fields["warc-record-id"], kind, int(page) if page else None, fields.get("warc-target-uri"), fields.get("warc-refers-to"), base64.b32decode(declared).hex() if declared else None)
        digest, n, no = hashlib.sha1(), 0, 0
        while True:
            data = source.take(min(left, chunk)) if left else b""
            if left and not data:
                raise EOFError(f"record {common[0]} is cut off")
            left -= len(data)
            n += len(data)
            digest.update(data)
            yield (*common, no, data, digest.copy().hexdigest(), n, left == 0)
            no += 1
            if not left:
                break
        source.take(4)


def _reader(batches):
    names = [f.split()[0] for f in CHUNK_SCHEMA.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}[f.split()[1]] for f in CHUNK_SCHEMA.split(", ")]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for batch in batches:
        for path in batch.column(0).to_pylist():
            where, name = opened(path)
            with where.open_input_stream(name, compression=None) as stream:
                rows, size = [], 0
                for row in records(stream):
                    rows.append(row)
                    size += len(row[7])
                    if size >= 4 * CHUNK or len(rows) >= 2048:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)


def read_archives(manifest: DataFrame) -> DataFrame:
    """Chunk rows of the archives that a manifest (path, ...) names; one archive for each task."""
    n = max(1, manifest.count())
    return manifest.select("path").repartition(n).mapInArrow(_reader, CHUNK_SCHEMA)


def payloads(chunks: DataFrame) -> DataFrame:
    """One row for each record: page_id, payload_bytes, payload_digest, record_type, refers_to, all of the full payload.

    A revisit has the length of the response it refers to and the digest of its own header; the
    running digest of the last chunk must be the digest that the response declares.
    """
    ends = written(chunks.where("last").drop("data", "chunk_no"), "record-ends")
    wrong = ends.where("record_type = 'response' and declared_digest is not null and declared_digest <> sha1")
    if not wrong.isEmpty():
        raise ValueError("a payload differs from the digest in its header")
    response = ends.where("record_type = 'response'").groupBy("record_id").agg(F.max("page_id").alias("of"), F.max("n_bytes").alias("whole"))
    revisit: Column = F.col("record_type") == "revisit"
    revisits = ends.where(revisit)
    asked = revisits.groupBy("refers_to_id").agg(F.expr(f"1 + count(*) div {ROWS_PER_SALT}").alias("salts"))
    asked = written(asked.join(response.withColumnRenamed("record_id", "refers_to_id"), "refers_to_id", "left"), "referred")
    busy = checked_broadcast(asked.where("salts > 1").select("refers_to_id", F.col("salts").alias("spread")))
    spread = asked.withColumn("salt", F.explode(F.expr("sequence(0L, salts - 1)")))
    salted = revisits.join(busy, "refers_to_id", "left").withColumn("salt", F.pmod(F.xxhash64("record_id"), F.coalesce("spread", F.lit(1).cast("long"))))
    back = salted.join(spread, ["refers_to_id", "salt"], "left")
    back = back.select("page_id", F.col("whole").alias("payload_bytes"), F.col("declared_digest").alias("payload_digest"), "record_type", F.col("of").alias("refers_to"))
    own = ends.where(~revisit).select("page_id", F.col("n_bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(back)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages into archives in the shared folder and read them back."""
    return payloads(read_archives(write_archives(pages, scratch(spark, "warc"))))
