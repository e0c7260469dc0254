"""WARC archives as a Spark data source: one gzip member per record, readable from any byte range.

Writing: each task writes one file under ``_attempts`` and the driver moves the files of successful attempts
next to each other, so lost executors leave no half-written or doubled records. Reading: a file is cut into
byte ranges. A task scans its range for the gzip magic, takes a place for a record only if the member that
would begin there decodes to a WARC header, and then owns every record that starts inside its range, reading
past its end to finish the last one. Folders may be on any store that ``pyarrow.fs`` opens by URI.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from stationcare.operators.skew import spread_join
from stationcare.session import shared_dir, staged

SPLIT_BYTES = 32 << 20
READ_BYTES = 1 << 18
BATCH_BYTES = 4 << 20
MAGIC = b"\x1f\x8b\x08"
EPOCH = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = ("record_id string, record_type string, target_uri string, refers_to string, payload_digest string, "
          "payload_bytes long, payload binary")


def base32_sha1(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def encode_record(record_id: str, record_type: str, target_uri: str | None, refers_to: str | None,
                  digest: str, payload: bytes) -> bytes:
    """One gzip member. A revisit carries the HTTP head only; its Content-Length still is the full payload's."""
    head = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = head if record_type == "revisit" else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {EPOCH}",
             "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if target_uri is not None:
        lines.append("WARC-Target-URI: " + target_uri.replace("\r", " ").replace("\n", " "))
    if record_type == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def decode_record(raw: bytes) -> dict:
    """Fields of one record; the digest of a payload that is there must agree with the header."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode(errors="replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = rest[:int(fields.get("content-length", len(rest)))]
    http, found, payload = block.partition(b"\r\n\r\n")
    digest = fields.get("warc-payload-digest", "").rpartition(":")[2] or None
    size = len(payload)
    if fields.get("warc-type") == "revisit":
        lengths = [x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size, payload = int(lengths[0]) if lengths else 0, None
    elif digest and digest != base32_sha1(payload):
        raise ValueError(f"payload of {fields.get('warc-record-id')} differs from its digest")
    strip = lambda v: v.strip("<>") if v else None
    return {"record_id": strip(fields.get("warc-record-id")), "record_type": fields.get("warc-type"),
            "target_uri": fields.get("warc-target-uri"), "refers_to": strip(fields.get("warc-refers-to")),
            "payload_digest": digest, "payload_bytes": size, "payload": payload}


class _Window:
    """Bytes of an open file from some place on, read ahead in blocks."""

    def __init__(self, handle, start: int):
        self.handle, self.start, self.held = handle, start, bytearray()
        handle.seek(start)

    def more(self) -> bool:
        block = self.handle.read(READ_BYTES)
        self.held += block
        return bool(block)

    def drop(self, to: int) -> None:
        del self.held[:to - self.start]
        self.start = to


def _member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The decoded member that begins at this place, and where it ends; None if none begins here."""
    unpack = zlib.decompressobj(31)
    out, fed, checked = [], at - window.start, False
    try:
        while not unpack.eof:
            if fed >= len(window.held) and not window.more():
                return None
            block = bytes(window.held[fed:fed + READ_BYTES])
            fed += len(block)
            out.append(unpack.decompress(block))
            if not checked and sum(map(len, out)) >= 7:
                if not b"".join(out).startswith(b"WARC/1."):
                    return None
                checked = True
    except zlib.error:
        return None
    raw = b"".join(out)
    if not raw.startswith(b"WARC/1.") or b"\r\n\r\n" not in raw:
        return None
    return raw, window.start + fed - len(unpack.unused_data)


def records_in(handle, start: int, end: int) -> Iterator[dict]:
    """Records whose members begin in [start, end)."""
    window, at = _Window(handle, start), start
    while at < end:
        found = None
        while True:
            place = window.held.find(MAGIC, at - window.start)
            if place >= 0:
                at = window.start + place
                break
            at = max(at, window.start + len(window.held) - len(MAGIC) + 1)
            window.drop(at)
            if at >= end or not window.more():
                return
        if at >= end:
            return
        found = _member(window, at)
        if found is None:
            at += 1
            continue
        raw, at = found
        window.drop(at)
        yield decode_record(raw)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[Range]:
        store, folder = pafs.FileSystem.from_uri(self.path)
        files = store.get_file_info(pafs.FileSelector(folder))
        ranges = [Range(f.path, low, min(low + self.split, f.size)) for f in sorted(files, key=lambda f: f.path)
                  if f.is_file and f.path.endswith(".warc.gz") for low in range(0, f.size, self.split)]
        return ranges or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = pafs.FileSystem.from_uri(self.path)
        rows, held = [], 0
        with store.open_input_file(partition.path) as handle:
            for record in records_in(handle, partition.start, partition.end):
                rows.append(record)
                held += len(record["payload"] or b"") + 200
                if held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    names = [part.split()[0] for part in SCHEMA.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names],
                                      names)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = pafs.FileSystem.from_uri(self.path)
        name, out = f"{uuid.uuid4().hex}.warc.gz", None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        store.create_dir(f"{folder}/_attempts", recursive=True)
                        out = store.open_output_stream(f"{folder}/_attempts/{name}", compression=None)
                    payload = row["payload"] or b""
                    out.write(encode_record(row["record_id"], row["record_type"], row["target_uri"],
                                            row["refers_to"], row["payload_digest"] or base32_sha1(payload), payload))
        finally:
            if out is not None:
                out.close()
        return Written(name if out is not None else None)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = pafs.FileSystem.from_uri(self.path)
        store.create_dir(folder, recursive=True)
        for message in messages:
            if message is not None and message.name:
                store.move(f"{folder}/_attempts/{message.name}", f"{folder}/{message.name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = pafs.FileSystem.from_uri(self.path)
        for message in messages:
            if message is not None and message.name:
                store.delete_file(f"{folder}/_attempts/{message.name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def write_archives(records: DataFrame, path: str) -> None:
    """Write rows of ``SCHEMA``'s columns but ``payload_bytes`` (null payload: empty) as archives in a folder."""
    records.sparkSession.dataSource.register(WarcSource)
    (records.withColumn("payload_bytes", F.lit(None).cast("long"))
     .select(*[part.split()[0] for part in SCHEMA.split(",")]).write.format("warc").mode("append").save(path))


def read_archives(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of every ``*.warc.gz`` in a folder, as ``SCHEMA``. No file, or an empty one, gives no rows."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("splitBytes", split_bytes).load(path)


def page_records(pages: DataFrame, revisit_bytes: int = 0) -> DataFrame:
    """Pages as records: of equal payloads of at least ``revisit_bytes`` the largest page_id is a response, the
    others revisit it; smaller payloads are all responses.

    Null html is an empty payload. Repeated rows that share the largest page_id are all responses; rows without
    a page_id revisit the largest one of their payload, or are responses if there is none.
    """
    kept = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    kept = kept.withColumn("sha", F.sha1("payload"))
    groups = staged(kept.groupBy("sha").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("_n"),
                                            F.max(F.octet_length("payload")).alias("_size"))
                    .filter("_n > 1").withColumn("keeper", F.when(F.col("_size") >= revisit_bytes, F.col("keeper")))
                    .drop("_size"), "payloads")
    # one payload, such as the empty one, may be that of a third of the pages
    joined = spread_join(kept, groups.drop("_n"), ["sha"], "left", groups.select("sha", "_n"), pages.count())
    again = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("none")))
    return joined.select(name(F.col("page_id")).alias("record_id"),
                         F.when(again, "revisit").otherwise("response").alias("record_type"),
                         F.col("url").alias("target_uri"),
                         F.when(again, name(F.col("keeper"))).alias("refers_to"),
                         F.lit(None).cast("string").alias("payload_digest"), "payload")


def round_trip(pages: DataFrame, revisit_bytes: int = 0, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Write pages to archives in the shared folder and read them back: one row per page.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``; an empty table gives an empty table.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(page_records(pages, revisit_bytes), folder)
    number = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")
    return read_archives(spark, folder, split_bytes).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number("refers_to").alias("refers_to"))
