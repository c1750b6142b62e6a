"""WARC archives of pages, written and read as a table of chunks.

A payload is a run of rows (record, chunk number, bytes): the JVM cuts it, so no
Python worker ever holds more than a chunk of an oversized page. Digests are
carried from chunk to chunk. First the digests of all payloads are taken (payloads
are not moved); equal payloads are found by digest and the one of the smallest page
becomes the response, the others revisits. Then each record's heading row and its
chunk rows meet in one sorted run, and a task streams them into gzip members of an
archive file. The reader streams the files back into chunk rows with running
digests and checks each against the digest that the record states.

Files go to the shared folder under names of their task attempt; the table of
files (the manifest) is committed by Spark, so a lost or repeated attempt leaves
a file that nothing refers to. An archive is closed beyond ``ARCHIVE`` bytes.

Defined results: a null payload is empty; an empty payload is one empty chunk; a
page without an address gets one made of its id; a null id is the largest and a
revisit of it refers to null; rows equal in id, address and payload are records of
their own, the first of them the response where their payload's is; other columns
are not read, whatever their names; an empty table gives no archive and no rows.
Payloads are equal if length, SHA-1 and SHA-256 are.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.support import lean, new_path, quoted, saved, small_batches

#: Bytes of a chunk, of an archive file, and the fewest a task writes so that every
#: core has one.
CHUNK, ARCHIVE, SMALL_ARCHIVE = 256 << 10, 256 << 20, 4 << 20
LEVEL = 6
#: Payloads of fewer bytes are never revisits.
REVISIT_FROM = 0
#: Rows that one payload's head is dealt to, so that a payload that very many pages
#: share is not one join key.
SALTS = 16


def chunks(pages: DataFrame) -> DataFrame:
    """(page_id, url, key, chunk, last, payload): the payloads cut into rows, those of
    a record one after the other. ``key`` tells rows of one id apart."""
    rows = pages.select(quoted("page_id").cast("long").alias("page_id"), quoted("url").cast("string").alias("url"),
                        F.coalesce(quoted("html").cast("string"), F.lit("")).cast("binary").alias("data"))
    rows = rows.withColumn("key", F.xxhash64("url", "data"))
    rows = rows.withColumn("ends", F.greatest(F.ceil(F.octet_length("data") / CHUNK), F.lit(1)).cast("int") - 1)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("ends"))).alias("chunk"))
    return rows.select("page_id", "url", "key", "chunk", (F.col("chunk") == F.col("ends")).alias("last"),
                       F.substring("data", F.col("chunk") * CHUNK + 1, F.lit(CHUNK)).alias("payload"))


def _digesting(batches):
    """One row per record: length and digests of its payload, from its chunk rows."""
    sha, check, size = None, None, 0
    for batch in batches:
        out = []
        columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "key", "chunk", "last"))
        for (page_id, url, key, chunk, last), payload in zip(zip(*columns), batch.column("payload")):
            if chunk == 0:
                sha, check, size = hashlib.sha1(), hashlib.sha256(), 0
            data = payload.as_buffer()
            sha.update(data)
            check.update(data)
            size += len(data)
            if last:
                out.append((page_id, url, key, size, sha.digest(), check.digest()))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                names=["page_id", "url", "key", "size", "sha", "check"])


def records(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """(page_id, url, key, size, sha, copies, response, head_id, head_key): one row
    per distinct page row. ``response``: whether its first copy holds the payload;
    head_*: the row that does."""
    found = chunks(pages).mapInArrow(lean(_digesting), "page_id long, url string, key long, size long, sha binary, check binary")
    rows = saved(found, "warc-digests").groupBy("page_id", "url", "key", "size", "sha", "check").agg(F.count(F.lit(1)).alias("copies"))
    of = ["size", "sha", "check"]
    order = F.struct(F.col("page_id").isNull().alias("z"), F.col("page_id").alias("head_id"), F.col("key").alias("head_key"))
    heads = (rows.groupBy(*of).agg(F.min(order).alias("head"), F.count(F.lit(1)).alias("n"))
             .where((F.col("n") > 1) & (F.col("size") >= revisit_from)).select(*of, "head.head_id", "head.head_key"))
    heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "key"), F.lit(SALTS)).cast("int"))
    rows = rows.join(heads, [*of, "salt"], "left")
    alone = F.col("head_key").isNull()
    return rows.select("page_id", "url", "key", "size", "sha", "copies",
                       (alone | (F.col("page_id").eqNullSafe(F.col("head_id")) & (F.col("key") == F.col("head_key")))).alias("response"),
                       F.when(alone, F.col("page_id")).otherwise(F.col("head_id")).alias("head_id"),
                       F.coalesce("head_key", "key").alias("head_key"))


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_urn(page_id, key, copy=0) -> str:
    digest = hashlib.md5(f"{page_id}:{key}:{copy}".encode()).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=digest)}>"


def _address(page_id, url):
    return re.sub("[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url or f"urn:page:{page_id}")


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def _heading(row, copy: int, response: bool) -> bytes:
    """A record's heading; a response's HTTP heading follows it."""
    http = _http(row["size"]) if response else b""
    lines = ["WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}",
             f"WARC-Record-ID: {record_urn(row['page_id'], row['key'], copy)}",
             "WARC-Date: 1970-01-01T00:00:00Z",  # the table holds no time of capture
             f"WARC-Target-URI: {_address(row['page_id'], row['url'])}",
             f"WARC-Payload-Digest: sha1:{base32(row['sha'])}", f"X-Payload-Length: {row['size']}"]
    if row["page_id"] is not None:
        lines.append(f"X-Page-ID: {row['page_id']}")
    if response:
        lines.append("Content-Type: application/http; msgtype=response")
    else:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {record_urn(row['head_id'], row['head_key'])}"]
        if row["head_id"] is not None:
            lines.append(f"X-Refers-To-Page-ID: {row['head_id']}")
    lines.append(f"Content-Length: {len(http) + (row['size'] if response else 0)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


class _Archive:
    """Archive files of one task, a gzip member per record."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.store, self.base = fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        self.name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        self.number, self.out, self.files, self.records = 0, None, [], 0

    def open_record(self):
        if self.out is not None and self.out.tell() >= ARCHIVE:
            self.close()
        if self.out is None:
            self.path = f"{self.base}/{self.name}-{self.number:03d}.warc.gz"
            self.number += 1
            self.out = self.store.open_output_stream(self.path, compression=None)
        self.gzip = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        self.records += 1

    def write(self, data):
        self.out.write(self.gzip.compress(data))

    def close_record(self):
        self.write(b"\r\n\r\n")
        self.out.write(self.gzip.flush())

    def close(self):
        if self.out is not None:
            size = self.out.tell()
            self.out.close()
            self.files.append((self.path, size, self.records))
            self.out, self.records = None, 0


def _writing(folder: str, revisit_from: int):
    """Task: sorted heading and chunk rows to archive files; returns their names."""
    def write(batches):
        archive, row, after, kept = None, None, -1, []

        def end(row, kept):
            """Close the record, then write the row's further copies."""
            if row is None:
                return
            if row["response"]:
                archive.close_record()
            for copy in range(1 if row["response"] else 0, row["copies"]):
                response = row["size"] < revisit_from
                archive.open_record()
                archive.write(_heading(row, copy, response))
                for data in kept if response else ():
                    archive.write(data)
                archive.close_record()

        for batch in batches:
            archive = archive or _Archive(folder)
            meta = batch.select([c for c in batch.schema.names if c != "payload"]).to_pylist()
            for now, payload in zip(meta, batch.column("payload")):
                if now["chunk"] < 0:
                    end(row, kept)
                    row, after, kept = now, -1, []
                    if row["response"]:
                        archive.open_record()
                        archive.write(_heading(row, 0, True))
                elif now["chunk"] != after:  # a copy's chunk follows the chunk it equals
                    after = now["chunk"]
                    if row["response"]:
                        archive.write(payload.as_buffer())
                        if row["copies"] > 1 and row["size"] < revisit_from:
                            kept.append(payload.as_py())
        if archive:
            end(row, kept)
            archive.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in archive.files], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
                names=["path", "bytes", "records"])
    return lean(write)


def _shared_uri(spark: SparkSession, path: str) -> str:
    """The folder with its store's scheme, made on the store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    uri = store.makeQualified(path).toUri().toString()
    return re.sub("^file:/+", "file:///", uri)


def write_archives(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Archives of all ``pages`` (page_id, url, html) in the shared folder; the
    manifest (folder, path, bytes, records)."""
    spark = pages.sparkSession
    with small_batches(spark):
        table = saved(records(pages, revisit_from), "warc-records")
        total = table.agg(F.sum("size")).first()[0] or 0
        tasks = max(1, -(-total // ARCHIVE), min(spark.sparkContext.defaultParallelism, total // SMALL_ARCHIVE))
        meta = ["url", "size", "sha", "copies", "response", "head_id", "head_key"]
        headings = table.select("page_id", "key", F.lit(-1).alias("chunk"), F.lit(None).cast("binary").alias("payload"), *meta)
        bodies = chunks(pages).select("page_id", "key", "chunk", "payload",
                                      *[F.lit(None).cast(table.schema[c].dataType).alias(c) for c in meta])
        rows = headings.union(bodies).repartition(tasks, "page_id", "key").sortWithinPartitions("page_id", "key", "chunk")
        folder = _shared_uri(spark, new_path(spark, "warc"))
        out = rows.mapInArrow(_writing(folder, revisit_from), "path string, bytes long, records long")
        return saved(out.withColumn("folder", F.lit(folder)), "warc-manifest")


class _Source:
    """Decompressed bytes of an archive file, a little at a time."""

    def __init__(self, stream):
        self.stream, self.inflate, self.data, self.rest = stream, None, b"", b""

    def _more(self) -> bool:
        """Some more bytes at the end of ``data``; False at the end of the file."""
        while True:
            if not self.rest:
                self.rest = self.stream.read(CHUNK)
                if not self.rest:
                    if self.inflate is not None:
                        raise ValueError("archive ends inside a record")
                    return False
            if self.inflate is None:
                self.inflate = zlib.decompressobj(31)
            got = self.inflate.decompress(self.rest, CHUNK)
            if self.inflate.eof:
                self.rest, self.inflate = self.inflate.unused_data, None
            else:
                self.rest = self.inflate.unconsumed_tail
            if got:
                self.data += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        """The bytes before ``mark``, which is skipped; None at the end of the file."""
        while mark not in self.data:
            if not self._more():
                if self.data:
                    raise ValueError("archive ends inside a heading")
                return None
        found, self.data = self.data.split(mark, 1)
        return found

    def some(self, most: int) -> bytes:
        """Between 1 and ``most`` of the next bytes."""
        if not self.data and not self._more():
            raise ValueError("archive ends inside a record")
        found, self.data = self.data[:most], self.data[most:]
        return found


def _fields(heading: bytes) -> dict[str, str]:
    lines = heading.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    return {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}


def _chunk_rows(source: _Source):
    """Rows of one archive file: record fields, chunk number, bytes and digest so far."""
    while (heading := source.until(b"\r\n\r\n")) is not None:
        f = _fields(heading)
        left = int(f["content-length"])
        stated = f["warc-payload-digest"].removeprefix("sha1:")
        page, refers = (int(f[k]) if k in f else None for k in ("x-page-id", "x-refers-to-page-id"))
        record = (page, f["warc-record-id"], f["warc-type"], f.get("warc-refers-to"), refers)
        if f["warc-type"] == "response":
            left -= len(source.until(b"\r\n\r\n")) + 4  # the HTTP heading
            sha, size, chunk = hashlib.sha1(), 0, 0
            while True:
                # Whole chunks but for the last, so that the rows are those written.
                piece, want = [], min(CHUNK, left)
                while want:
                    piece.append(source.some(want))
                    want -= len(piece[-1])
                data = b"".join(piece)
                left -= len(data)
                size += len(data)
                sha.update(data)
                digest = base32(sha.digest())
                if not left and digest != stated:
                    raise ValueError(f"payload of {record[1]} is not the one its digest states")
                yield (*record, chunk, not left, size, digest, data)
                chunk += 1
                if not left:
                    break
        else:
            yield (*record, 0, True, int(f["x-payload-length"]), stated, b"")
        if source.until(b"\r\n\r\n") != b"":
            raise ValueError(f"record {record[1]} is longer than it states")


_ROWS = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to_record", pa.string()),
                   ("refers_to", pa.int64()), ("chunk", pa.int32()), ("last", pa.bool_()), ("payload_bytes", pa.int64()),
                   ("payload_digest", pa.string()), ("payload", pa.binary())])
_DDL = ("page_id long, record_id string, record_type string, refers_to_record string, refers_to long, chunk int, last boolean, "
        "payload_bytes long, payload_digest string, payload binary")


def _reading(with_payload: bool):
    def read(batches):
        from pyarrow import fs

        for batch in batches:
            for folder, path in zip(batch.column("folder").to_pylist(), batch.column("path").to_pylist()):
                store, _ = fs.FileSystem.from_uri(folder)
                with store.open_input_stream(path, compression=None) as stream:
                    held, size = [], 0
                    for row in _chunk_rows(_Source(stream)):
                        if not with_payload:
                            if not row[6]:
                                continue
                            row = (*row[:-1], None)
                        held.append(row)
                        size += len(row[-1] or b"")
                        if len(held) == 1000 or size >= 16 * CHUNK:
                            yield _batch(held)
                            held, size = [], 0
                    if held:
                        yield _batch(held)
    return lean(read)


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ROWS)], schema=_ROWS)


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The archives' chunk rows: record fields, chunk number, and length and digest of
    the payload up to and with that chunk. Without payloads: only each record's last
    row. A payload that is not the one its record's digest states is an error."""
    files = max(1, manifest.count())
    return manifest.select("folder", "path").repartition(files).mapInArrow(_reading(with_payload), _DDL)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Contract rows of the archive query."""
    rows = read_archives(write_archives(pages), with_payload=False)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
