"""WARC archives of pages, written from and read back into a table of chunks.

A payload is cut into chunks before it leaves Spark's columns, and an archive is read in
chunks as well, so that neither side holds a whole record. A chunk row carries how far
the record has come: its bytes so far and their digest. Equal payloads are stored once,
as the response of the greatest key; the other records of that payload revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm.common import importable
from postlens.llm.order_minhash import row_key

CHUNK = 1 << 20
LEVEL = 6  # of compression; each record is a gzip member of its own

# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:x-record:"
DATE = "1970-01-01T00:00:00Z"

CHUNKS = (
    "key bigint, record_type string, refers_to bigint, uri string, header_digest string, "
    "header_bytes bigint, chunk int, data binary, bytes_so_far bigint, digest_so_far string, last boolean"
)


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def with_records(pages: DataFrame, key: str, payload: str, least: int = 0) -> DataFrame:
    """`row, key, sha1, size, refers_to` for distinct (key, payload) rows.

    Of equal payloads of at least `least` bytes the row of the greatest key is the response
    (`refers_to` NULL) and the others refer to it. NULL keys are never greatest. Only
    digests are shuffled, and a payload's greatest key is found before any row meets it.
    """
    data = _payload(F.col(payload))
    narrow = pages.select(
        _row(pages, key, payload),
        F.col(key).alias("key"),
        F.sha1(data).alias("sha1"),
        F.length(data).cast("bigint").alias("size"),
    ).distinct()
    greatest = narrow.where(F.col("size") >= least).groupBy("sha1").agg(F.max("key").alias("_greatest"))
    other = ~F.col("key").eqNullSafe(F.col("_greatest")) & (F.col("size") >= least)
    refers = F.when(other, F.col("_greatest")).alias("refers_to")
    return narrow.join(greatest, "sha1", "left").select("row", "key", "sha1", "size", refers)


def _payload(payload: Column) -> Column:
    return F.encode(F.coalesce(payload, F.lit("")), "UTF-8")


def _row(pages: DataFrame, key: str, payload: str) -> Column:
    return row_key(F.col(key), F.sha1(_payload(F.col(payload)))).alias("row")


def write_archives(
    pages: DataFrame,
    folder: str,
    key: str = "page_id",
    uri: str = "url",
    payload: str = "html",
    least: int = 0,
    chunk: int = CHUNK,
) -> DataFrame:
    """One record for each row of `pages`, in a gzip archive per task; returns their paths.

    NULL payloads are empty, NULL keys and URIs are left out of the headers. Repeated rows
    give repeated records. An archive gets its name once it is whole, so a task that is run
    again replaces it by the same one. An empty table gives no archives.
    """
    spark = pages.sparkSession
    importable(spark)
    rows = pages.select(
        _row(pages, key, payload), F.col(uri).cast("string").alias("uri"), _payload(F.col(payload)).alias("data")
    )
    joined = rows.join(with_records(pages, key, payload, least), "row")
    stored = F.when(F.col("refers_to").isNull(), F.col("size")).otherwise(F.lit(0))
    numbered = joined.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.ceil(stored / chunk).cast("int"))))
    pieces = numbered.select(
        "key",
        "uri",
        "sha1",
        "size",
        "refers_to",
        "chunk",
        F.when(
            F.col("chunk") > 0,
            F.substring("data", (F.col("chunk") - 1) * chunk + 1, F.lit(chunk)),
        ).alias("data"),
    )
    written = pieces.mapInArrow(lambda stream: _write(stream, folder), "path string, records bigint")
    written.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def header(key, uri, sha1: str, size: int, refers_to) -> bytes:
    """The head of a record: WARC fields, and the HTTP fields that stand before its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    revisit = refers_to is not None
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{RECORD}{'' if key is None else key}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(bytes.fromhex(sha1))}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(http) + (0 if revisit else size))),
    ]
    if uri is not None:
        fields.insert(3, ("WARC-Target-URI", uri.replace("\r", "%0D").replace("\n", "%0A")))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{RECORD}{refers_to}>")]
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return f"WARC/1.1\r\n{lines}\r\n{http}".encode()


def _write(stream: Iterator, folder: str) -> Iterator:
    """Rows in order of record and chunk to one archive; chunk 0 opens a record."""
    import pyarrow as pa
    from pyarrow import fs
    from pyspark import TaskContext

    task = TaskContext.get()
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    name = f"{root}/part-{task.partitionId():05d}.warc.gz"
    draft = f"{root}/.draft-{task.taskAttemptId()}"
    out, packer, records = None, None, 0
    for batch in stream:
        for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            *head, chunk, data = row
            if chunk == 0:
                if out is None:
                    out = system.open_output_stream(draft)
                else:
                    out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                records += 1
                out.write(packer.compress(header(*head)))
            else:
                out.write(packer.compress(data))
    if out is not None:
        out.write(packer.compress(b"\r\n\r\n") + packer.flush())
        out.close()
        system.move(draft, name)
        yield pa.RecordBatch.from_pydict(
            {"path": [f"{folder}/{name.rpartition('/')[2]}"], "records": pa.array([records], pa.int64())}
        )


class Archive:
    """A gzip archive as one stream of bytes, of which little is held at a time."""

    def __init__(self, file, step: int = 1 << 18) -> None:
        self.file, self.step, self.held = file, step, b""
        self.unpacker = zlib.decompressobj(31)
        self.packed = b""

    def _more(self) -> bool:
        while True:
            if not self.packed:
                self.packed = self.file.read(self.step)
                if not self.packed:
                    return False
            if self.unpacker.eof:
                self.unpacker = zlib.decompressobj(31)
            data = self.unpacker.decompress(self.packed, self.step)
            self.packed = self.unpacker.unused_data if self.unpacker.eof else self.unpacker.unconsumed_tail
            if data:
                self.held += data
                return True

    def head(self) -> list[str] | None:
        """Lines up to an empty one; None at the end."""
        while b"\r\n\r\n" not in self.held:
            if not self._more():
                if self.held:
                    raise EOFError("an archive ends within a record's head")
                return None
        found, _, self.held = self.held.partition(b"\r\n\r\n")
        return found.decode().split("\r\n")

    def read(self, size: int) -> bytes:
        while len(self.held) < size:
            if not self._more():
                raise EOFError("an archive ends within a record")
        found, self.held = self.held[:size], self.held[size:]
        return found


def _fields(lines: list[str]) -> dict[str, str]:
    return {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}


def records(file, chunk: int = CHUNK) -> Iterator[tuple]:
    """The rows of `CHUNKS` of one archive: one or more for each record, in order."""
    archive = Archive(file)
    def number(value: str | None) -> int | None:
        digits = (value or "")[len(RECORD) + 1 : -1]
        return int(digits) if digits else None

    while (lines := archive.head()) is not None:
        fields = _fields(lines)
        http = archive.head()
        stored = int(fields["content-length"]) - len("\r\n".join(http).encode()) - 4
        head = (
            number(fields["warc-record-id"]),
            fields["warc-type"],
            number(fields.get("warc-refers-to")),
            fields.get("warc-target-uri"),
            fields["warc-payload-digest"].removeprefix("sha1:"),
            int(_fields(http)["content-length"]),
        )
        digest, done, at = hashlib.sha1(), 0, 0
        while True:
            data = archive.read(min(chunk, stored - done))
            digest.update(data)
            done += len(data)
            last = done == stored
            so_far = base32_sha1(digest.digest())
            if last and head[1] == "response" and so_far != head[4]:
                raise ValueError(f"the payload of record {head[0]} does not have its digest")
            yield (*head, at, data, done, so_far, last)
            at += 1
            if last:
                break
        if archive.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {head[0]} has no end")


def read_chunks(archives: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of the archives at `path`: at least one row for each record.

    Columns: `key`, `record_type`, `refers_to`, `uri`, `header_digest`, `header_bytes` of the
    record, then `chunk` (from 0), `data`, and of the data up to and with this chunk
    `bytes_so_far`, `digest_so_far` and whether it is the `last`. A payload of 0 bytes, or
    of a revisit, has one chunk without data. A damaged archive is an error.
    """
    import pyarrow as pa

    spark: SparkSession = archives.sparkSession
    importable(spark)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(kinds)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema.names
            )

        for batch in stream:
            for path in batch.column(0).to_pylist():
                system, place = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with system.open_input_stream(place, compression=None) as file:
                    for row in records(file, chunk):
                        rows.append(row)
                        held += len(row[7]) + 200
                        if held >= 4 * CHUNK:
                            yield out(rows)
                            rows, held = [], 0
                if rows:
                    yield out(rows)

    kinds = spark.createDataFrame([], CHUNKS).schema
    paths = archives.select("path")
    # A task for each archive: their number is that of the tasks that wrote them.
    return paths.repartition(max(1, paths.count()), "path").mapInArrow(batches, kinds)


def payloads(chunks: DataFrame) -> DataFrame:
    """One row per record: `key`, `payload_bytes`, `payload_digest`, `record_type`, `refers_to`."""
    stored = F.col("record_type") == "response"
    return chunks.where("last").select(
        "key",
        F.when(stored, F.col("bytes_so_far")).otherwise(F.col("header_bytes")).alias("payload_bytes"),
        F.when(stored, F.col("digest_so_far")).otherwise(F.col("header_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
