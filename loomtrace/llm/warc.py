"""WARC archives as a Spark data source, and page archives with revisit records (operator 1).

``spark.read.format("warc")`` plans whole files, packed to partitions by size. Filters on the
record type and the other header columns are pushed into the reader: a record's headers are parsed
first, and its payload is skipped, not decoded, if a filter fails or the schema does not ask for
it. Compressed archives hold one gzip member per record, as usual; members written here carry
their compressed size in the gzip header, so skipping is a seek. Archives without that field are
read through.

``df.write.format("warc")`` starts a new file when one is full, under a temporary name; a job's
commit moves the files of its successful tasks into place, so retried tasks leave nothing behind.

Cases: a null payload counts as empty, a null url has no target header (control characters in urls
are percent-encoded), a null page id is written as an empty one and comes back as null. Equal rows
are all written; of rows that share both payload and the largest id, all are responses. Empty
tables give an archive without files and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from .storage import filesystem, materialise, new_folder

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
ARROW = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
FILE_BYTES = 64 << 20
#: Digests that may count as frequent.
HOT = 1000
SPLIT_BYTES = 64 << 20


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- records -------------------------------------------------------------------------------


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(record_id: str, kind: str, uri: str | None, refers_to: str | None, payload: bytes, payload_digest: str, payload_bytes: int) -> bytes:
    """A response or revisit record. A revisit keeps the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_clean(record_id)}>", f"WARC-Date: {DATE}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_clean(uri)}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{_clean(refers_to or '')}>"]
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 2) -> bytes:
    """A gzip member with its compressed size in an extra field."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    extra = b"SL" + struct.pack("<HI", 4, len(body))
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _headers(data: bytes) -> tuple[dict[str, str], int] | None:
    """WARC headers and where the block begins; None if they aren't complete."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = data[:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, end + 4


class _Records:
    """The records of an open file: headers, and a function that gives the block."""

    def __init__(self, source: io.BufferedReader):
        self.source = source

    def __iter__(self) -> Iterator[tuple[dict[str, str], object]]:
        head = self.source.peek(2)[:2]
        yield from self._zipped() if head == b"\x1f\x8b" else self._plain()

    def _plain(self) -> Iterator[tuple[dict[str, str], object]]:
        while True:
            lines = []
            while (line := self.source.readline()) not in (b"\r\n", b"\n", b""):
                lines.append(line.rstrip(b"\r\n"))
            if not lines:
                if line == b"":
                    return
                continue
            headers, _ = _headers(b"\r\n".join(lines) + b"\r\n\r\n")
            begin, size = self.source.tell(), int(headers.get("content-length", 0))
            yield headers, lambda: (self.source.seek(begin), self.source.read(size))[1]
            self.source.seek(begin + size)

    def _zipped(self) -> Iterator[tuple[dict[str, str], object]]:
        while len(fixed := self.source.read(10)) == 10:
            size = None
            if fixed[3] & 4:
                extra = self.source.read(struct.unpack("<H", self.source.read(2))[0])
                if extra[:2] == b"SL":
                    size = struct.unpack("<I", extra[4:8])[0]
            for flag in (8, 16):
                if fixed[3] & flag:
                    while self.source.read(1) not in (b"\0", b""):
                        pass
            if fixed[3] & 2:
                self.source.read(2)
            begin = self.source.tell()
            inflate, data, left = zlib.decompressobj(-15), b"", size

            def more(most: int = 0) -> bool:
                """Read on; most: bytes to decode at least (0: all)."""
                nonlocal data, left
                if inflate.eof:
                    return False
                raw = inflate.unconsumed_tail
                if not raw:
                    raw = self.source.read(min(1 << 16, left) if left is not None else 1 << 16)
                    left = None if left is None else left - len(raw)
                data += inflate.decompress(raw, most) if most else inflate.decompress(raw)
                return bool(raw) and not inflate.eof

            going = True
            while (found := _headers(data)) is None and going:
                going = more(2048)
            if found is None:
                raise ValueError("a gzip member without a WARC record")
            headers, at = found

            def block() -> bytes:
                while more():
                    pass
                return data[at : at + int(headers.get("content-length", 0))]

            yield headers, block
            if size is not None:
                self.source.seek(begin + size + 8)
            else:
                while more():
                    pass
                self.source.seek(self.source.tell() - len(inflate.unused_data) + 8)


# ---- data source ---------------------------------------------------------------------------


@dataclass
class _Files(InputPartition):
    paths: tuple[str, ...]

    def __init__(self, paths: tuple[str, ...]):
        super().__init__(None)
        self.paths = paths


@dataclass
class _Written(WriterCommitMessage):
    parts: tuple[tuple[str, str], ...]


class WarcDataSource(DataSource):
    """Options: path; compression (gzip or none) and file_bytes to write; verify (true: digests of
    responses are computed from their payloads and must equal the headers')."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("archives are only ever added; write to a new folder")
        return WarcWriter(dict(self.options))


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.verify = options["path"], options.get("verify", "false").lower() == "true"
        self.columns = [(f.name, ARROW[f.dataType.simpleString()]) for f in schema]
        self.wanted: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else ""
            if isinstance(f, EqualTo) and name in HEADERS:
                self.wanted.append((name, (f.value,)))
            elif isinstance(f, In) and name in HEADERS:
                self.wanted.append((name, tuple(f.value)))
            else:
                if isinstance(f, IsNotNull) and name in HEADERS:
                    self.wanted.append((name, ()))
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        system, path = filesystem(self.path)
        found = system.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
        scheme = "" if isinstance(system, pafs.LocalFileSystem) else self.path.split("://")[0] + "://"
        files = sorted((f.path, f.size) for f in found if f.is_file and re.search(r"\.warc(\.gz)?$", f.path))
        parts, own, size = [], [], 0
        for name, n in files:
            if own and size + n > SPLIT_BYTES:
                parts.append(_Files(tuple(own)))
                own, size = [], 0
            own.append(scheme + name)
            size += n
        return [*parts, _Files(tuple(own))] if own else parts or [_Files(())]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        names = [c for c, _ in self.columns]
        decode = "payload" in names or "payload_bytes" in names or self.verify
        rows: list[tuple] = []
        size = 0
        for path in partition.paths:
            system, name = filesystem(path)
            with io.BufferedReader(system.open_input_file(name), 1 << 18) as source:
                for headers, block in _Records(source):
                    row = {c: headers.get(h) for c, h in HEADERS.items()}
                    for c in ("record_id", "refers_to"):
                        row[c] = row[c][1:-1] if row[c] is not None and row[c][:1] == "<" else row[c]
                    if row["payload_digest"]:
                        row["payload_digest"] = row["payload_digest"].rpartition(":")[2]
                    if any(row[c] is None or (values and row[c] not in values) for c, values in self.wanted):
                        continue
                    if decode:
                        http, _, payload = block().partition(b"\r\n\r\n")
                        if row["record_type"] == "revisit":
                            length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
                            row["payload_bytes"], row["payload"] = length and int(length[1]), None
                        else:
                            row["payload_bytes"], row["payload"] = len(payload), payload
                            if self.verify and digest(payload) != row["payload_digest"]:
                                raise ValueError(f"payload of {row['record_id']} in {path} does not have its digest")
                    rows.append(tuple(row.get(c) for c in names))
                    size += len(row.get("payload") or b"") if "payload" in names else 0
                    if len(rows) >= 4096 or size > 8 << 20:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(zip(*rows), self.columns)], schema=pa.schema(self.columns))


class WarcWriter(DataSourceArrowWriter):
    """Rows: record_id, record_type, target_uri, refers_to, payload_digest, payload_bytes, payload."""

    def __init__(self, options: dict):
        self.path, self.zipped = options["path"].rstrip("/"), options.get("compression", "gzip") == "gzip"
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, folder = filesystem(self.path)
        system.create_dir(folder, recursive=True)
        parts: list[tuple[str, str]] = []
        out, size = None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    name = f"{folder}/part-{uuid.uuid4().hex}.warc" + ".gz" * self.zipped
                    parts.append((name + ".tmp", name))
                    out, size = system.open_output_stream(name + ".tmp"), 0
                data = record(row["record_id"], row["record_type"], row["target_uri"], row["refers_to"], row["payload"] or b"", row["payload_digest"], row["payload_bytes"])
                data = member(data) if self.zipped else data
                out.write(data)
                size += len(data)
                if size >= self.file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return _Written(tuple(parts))

    def commit(self, messages: list) -> None:
        system, _ = filesystem(self.path)
        for m in messages:
            for part, name in m.parts if m else ():
                system.move(part, name)

    def abort(self, messages: list) -> None:
        system, _ = filesystem(self.path)
        for m in messages:
            for part, _ in m.parts if m else ():
                system.delete_file(part)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# ---- page archives -------------------------------------------------------------------------


def archive_records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """The records of a page archive. Of equal payloads of ``min_bytes`` or more, the page with
    the largest id is the response and the others revisit it."""
    payload = F.coalesce(pages[html_col].cast("binary"), F.lit(b""))
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"))
    # Digests and ids alone are counted. A digest of more than a thousandth of all repeats is one
    # of a thousand at most; these are broadcast, and their pages are spread over the join of the rest.
    keys = rows.where(F.octet_length("payload") >= min_bytes).select("id", "sha1")
    same = materialise(keys.groupBy("sha1").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1").select(F.col("sha1").alias("of"), "last", "n"), "warc-same")
    bound = (same.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // HOT
    often = same.where(F.col("n") > bound).select(F.col("of").alias("hot_of"), F.col("last").alias("hot_last"))
    marked = rows.join(F.broadcast(often), F.col("sha1") == F.col("hot_of"), "left")
    key = F.when(F.col("hot_of").isNull(), F.col("sha1")).otherwise(F.concat(F.lit("#"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    joined = marked.join(same.where(F.col("n") <= bound).select("of", F.col("last").alias("own_last")), key == F.col("of"), "left").withColumn("last", F.coalesce("hot_last", "own_last"))
    again = F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return joined.select(urn("id").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"), F.when(again, urn("last")).alias("refers_to"), F.col("sha1").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"), "payload")


def _base32(hexadecimal):
    """Base32 of a hexadecimal column, five bits at a time, JVM-side."""
    bits = F.lpad(F.conv(F.lit("0"), 16, 2), 0, "0")
    for i in range(0, 40, 10):  # ten digits are 40 bits, eight letters
        bits = F.concat(bits, F.lpad(F.conv(F.substring(hexadecimal, i + 1, 10), 16, 2), 40, "0"))
    letters = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.substr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.conv(F.substr(bits, k * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1)))
    return F.array_join(letters, "")


def write_archive(pages: DataFrame, folder: str | None = None, *, compression: str = "gzip", **options) -> str:
    """Write a page archive; returns its folder."""
    spark = pages.sparkSession
    register(spark)
    folder = folder or new_folder(spark, "warc")
    records = archive_records(pages, **options).withColumn("payload_digest", _base32(F.col("payload_digest")))
    records.write.format("warc").mode("append").option("compression", compression).save(folder)
    return folder


def read_archive(spark: SparkSession, folder: str, *, columns: str = SCHEMA, verify: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("warc").schema(columns).option("verify", str(verify).lower()).load(folder)


def page_report(spark: SparkSession, folder: str) -> DataFrame:
    """What the archive holds, per page: digests are checked against the payloads."""
    found = read_archive(spark, folder, columns="record_id string, record_type string, refers_to string, payload_digest string, payload_bytes long", verify=True)
    number = lambda c: F.when(F.substring(c, 10, 100) != "", F.substring(c, 10, 100)).cast("long")
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
