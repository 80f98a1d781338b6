"""Append-only JSONL files by byte ranges (S1-S3, S8-S14) and as a stream.

``spark.read.format("jsonl_lines")`` gives each complete line with its file and byte offset. Lines
end at ``\\n`` alone; an unfinished last line is left for the next read, and an offset inside a
line moves on to the next one. Files are cut into byte ranges of ``split_bytes``, each read by a
task of its own. ``growing_ranges`` is the stream of what such files get added.
"""

from __future__ import annotations

import glob
import io
import json
import os
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..functions.payload import parse_lines

SCHEMA = "file_path string, byte_offset long, line binary"
ARROW = pa.schema([("file_path", pa.string()), ("byte_offset", pa.int64()), ("line", pa.binary())])
SPLIT_BYTES = 32 << 20


@dataclass
class ByteRange(InputPartition):
    """Lines that begin at ``start`` or later and before ``stop``."""

    path: str
    start: int
    stop: int

    def __init__(self, path: str, start: int, stop: int):
        super().__init__(None)
        self.path, self.start, self.stop = path, start, stop


def read_range(part: ByteRange) -> Iterator[pa.RecordBatch]:
    """The lines of a range, blank ones left out."""
    with open(part.path, "rb") as source:
        yield from read_open(source, part.path, part.start, part.stop)


def read_open(source: BinaryIO, path: str, start: int, stop: int) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[str, int, bytes]] = []
    size = 0
    if start > 0:
        source.seek(start - 1)
        source.readline()  # the rest of a line that began before, or its line break alone
    while (at := source.tell()) < stop:
        line = source.readline()
        if not line.endswith(b"\n"):
            break
        if line.strip():
            rows.append((path, at, line[:-1]))
            size += len(line)
        if size > 4 << 20:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ARROW.types)], schema=ARROW)


def complete_end(path: str, start: int = 0) -> int:
    """S3: the offset after the last complete line, not before ``start``."""
    end = os.path.getsize(path)
    with open(path, "rb") as source:
        while end > start:
            begin = max(start, end - (1 << 16))
            source.seek(begin)
            if (at := source.read(end - begin).rfind(b"\n")) >= 0:
                return begin + at + 1
            end = begin
    return start


def list_files(path: str) -> list[str]:
    """A file, a glob, or the ``*.jsonl`` in a folder and in the projects directly below it,
    sorted. Folders below a project are not its transcripts."""
    if os.path.isdir(path):
        return sorted(x for pattern in ("*.jsonl", "*/*.jsonl") for x in glob.glob(os.path.join(glob.escape(path), pattern)))
    return sorted(glob.glob(path)) if glob.has_magic(path) else [path]


def project_dirs(root: str, spec: str | Sequence[str]) -> list[str]:
    """All projects (``*``) or those named; an unknown one is an error."""
    if spec == "*":
        return sorted(e.path for e in os.scandir(root) if e.is_dir())
    if isinstance(spec, str) or not isinstance(spec, Sequence):
        raise ValueError(f"projects must be '*' or a list, not {spec!r}")
    missing = [x for x in spec if not os.path.isdir(os.path.join(root, x))]
    if missing:
        raise ValueError(f"no such project: {', '.join(missing)}")
    return [os.path.join(root, x) for x in spec]


def _ranges(path: str, start: int, stop: int, split: int) -> list[ByteRange]:
    return [ByteRange(path, a, min(stop, a + split)) for a in range(start, stop, split)]


class JsonlLines(DataSource):
    """Options: path; offsets (JSON of path to byte offset); split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return LinesReader(dict(self.options))


class LinesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split_bytes", SPLIT_BYTES))
        self.offsets = json.loads(options.get("offsets", "{}"))

    def partitions(self) -> list[ByteRange]:
        parts = []
        for path in list_files(self.path):
            start = self.offsets.get(path, 0)
            parts += _ranges(path, start, complete_end(path, start), self.split)
        return parts or [ByteRange(os.devnull, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return read_range(partition)


# ---- files as they grow --------------------------------------------------------------------


@dataclass
class Folder(InputPartition):
    """The transcripts directly in a folder, or one file."""

    path: str

    def __init__(self, path: str):
        super().__init__(None)
        self.path = path


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class JsonlListing(DataSource):
    """``file_path, size, mtime_us`` of the transcripts below a path, anew with every batch. The driver
    lists the projects; what is in them is listed by tasks, one a project."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_listing"

    def schema(self) -> str:
        return "file_path string, size long, mtime_us long"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ListingStream(self.options["path"])


class ListingStream(DataSourceStreamReader):
    """The offset is a number that grows; what was read of a file is state of the query."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        return {"at": time.time_ns()}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        system, path = _opened(self.path)
        if system.get_file_info(path).type != fs.FileType.Directory:
            return [Folder(path)]
        inner = system.get_file_info(fs.FileSelector(path))
        return [Folder(path), *(Folder(x.path) for x in sorted(inner, key=lambda x: x.path) if x.type == fs.FileType.Directory)]

    def read(self, partition: Folder) -> Iterator[tuple[str, int, int]]:
        system = _opened(self.path)[0]
        info = system.get_file_info(partition.path)
        found = system.get_file_info(fs.FileSelector(partition.path)) if info.type == fs.FileType.Directory else [info]
        for x in found:
            if x.type == fs.FileType.File and x.path.endswith(".jsonl"):
                yield x.path, x.size, int(x.mtime_ns or 0) // 1000


def last_line_end(source: pa.NativeFile, start: int, size: int) -> int:
    """S3 for an open file: the offset after the last complete line before ``size``."""
    end = size
    while end > start:
        begin = max(start, end - (1 << 16))
        source.seek(begin)
        if (at := source.read(end - begin).rfind(b"\n")) >= 0:
            return begin + at + 1
        end = begin
    return start


def growing_ranges(spark: SparkSession, path: str) -> DataFrame:
    """A stream of ``file_path, start, stop``, what is new and complete of each file. How
    far a file was read, and its time then, is state of the query, kept by file. A file that became
    shorter is another one and is read from its beginning; keys that are known are not added again."""
    spark.dataSource.register(JsonlListing)

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        offset, seen = state.get if state.exists else (0, -1)
        out = []
        for batch in batches:
            for size, mtime in zip(batch["size"].tolist(), batch["mtime_us"].tolist()):
                offset = 0 if size < offset else offset
                if mtime == seen and size <= offset:
                    continue
                system, name = _opened(path)[0], key[0]
                with system.open_input_file(name) as source:
                    stop = last_line_end(source, offset, size)
                if stop > offset:
                    out.append((name, offset, stop))
                offset, seen = stop, mtime
        state.update((offset, seen))
        yield pd.DataFrame(out, columns=["file_path", "start", "stop"])

    listed = spark.readStream.format("jsonl_listing").load(path)
    return listed.groupBy("file_path").applyInPandasWithState(advance, "file_path string, start long, stop long", "offset long, seen long", "append", GroupStateTimeout.NoTimeout)


def transcript_ranges(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """``file_path, start, stop`` of the transcripts directly in folders, up to their last complete
    line. Each folder is listed, and its files' ends are looked for, by a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                system, name = _opened(folder)
                found = [x for x in system.get_file_info(fs.FileSelector(name)) if x.type == fs.FileType.File and x.path.endswith(".jsonl")]
                stops = []
                for x in found:
                    with system.open_input_file(x.path) as source:
                        stops.append(last_line_end(source, 0, x.size))
                yield pa.RecordBatch.from_arrays([pa.array([x.path for x in found], pa.string()), pa.array([0] * len(found), pa.int64()), pa.array(stops, pa.int64())], ["file_path", "start", "stop"])

    listed = spark.createDataFrame([(x,) for x in folders], "folder string").repartition(max(1, len(folders)), "folder")
    return listed.mapInArrow(run, "file_path string, start long, stop long")


def lines_of(ranges: DataFrame, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The lines of ranges of files below ``path``, cut into ranges of ``split_bytes`` for a task each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = _opened(path)[0]
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(row["file_path"]) as file, io.BufferedReader(file) as source:
                    yield from read_open(source, row["file_path"], row["start"], row["stop"])

    cut = F.explode(F.sequence("start", F.greatest("start", F.col("stop") - 1), F.lit(split_bytes)))
    parts = ranges.select("file_path", cut.alias("start"), "stop").withColumn("stop", F.least("stop", F.col("start") + split_bytes))
    return parts.repartition("file_path", "start").mapInArrow(run, SCHEMA)


def read_lines(spark: SparkSession, path: str, offsets: dict[str, int] | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    spark.dataSource.register(JsonlLines)
    return spark.read.format("jsonl_lines").option("offsets", json.dumps(offsets or {})).option("split_bytes", str(split_bytes)).load(path)


def stem(path) -> "F.Column":
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def parse_records(lines: DataFrame, threshold: int = 100_000) -> DataFrame:
    """Each line's fields; ``valid`` tells records from malformed lines.

    A record without uuid gets a name from its file and the digest of its bytes; without
    ``sessionId`` (absent, not null) it belongs to the file's session.
    """
    text = F.decode(F.col("line"), "UTF-8")
    rows = lines.withColumn("digest", F.sha2("line", 256)).withColumn("text", F.coalesce(F.call_function("try_validate_utf8", F.col("line").cast("string")), text))
    parsed = rows.withColumn("p", parse_lines(threshold)(F.col("text")))
    own = stem(F.col("file_path"))
    uuid = F.when(F.coalesce(F.col("p.uuid"), F.lit("")) == "", F.concat(F.lit("nouuid_"), own, F.lit("_"), F.substring("digest", 1, 16))).otherwise(F.col("p.uuid"))
    session = F.when(F.col("p.has_session"), F.col("p.session_id")).otherwise(own)
    moment = F.try_to_timestamp(F.col("p.timestamp")).cast("timestamp_ntz")
    return parsed.select("file_path", "byte_offset", F.col("p.valid").alias("valid"), uuid.alias("uuid"), session.alias("session_id"), F.col("p.type").alias("type"), moment.alias("timestamp"), F.col("p.parent_uuid").alias("parent_uuid"), F.col("p.raw").alias("raw"), F.col("p.blobs").alias("blobs"))


HISTORY = "timestamp long, display string, sessionId string, project string"


def read_history(spark: SparkSession, path: str, content_filter: str | None = None) -> DataFrame:
    """Valid lines with both keys, one per (timestamp, session)."""
    if not list_files(path) or not os.path.exists(list_files(path)[0]):
        return spark.createDataFrame([], "timestamp long, display string, session_id string, project string")
    lines = spark.read.text(path)
    if content_filter:
        lines = lines.where(F.lower("value").contains(content_filter.lower()))
    rows = lines.select(F.from_json("value", HISTORY).alias("h")).select("h.timestamp", "h.display", F.col("h.sessionId").alias("session_id"), "h.project")
    return rows.where("timestamp is not null and session_id is not null").dropDuplicates(["timestamp", "session_id"])


INDEX = "entries array<struct<sessionId:string,summary:string,firstPrompt:string,messageCount:int,created:string,modified:string,gitBranch:string,projectPath:string>>"


def read_session_index(spark: SparkSession, dirs: Sequence[str]) -> DataFrame:
    """The entries of all ``sessions-index.json``; of equal sessions the last folder's counts."""
    paths = [p for d in dirs if os.path.exists(p := os.path.join(d, "sessions-index.json"))]
    if not paths:
        return spark.createDataFrame([], "session_id string, summary string, first_prompt string, message_count int, created timestamp_ntz, modified timestamp_ntz, git_branch string, project_path string")
    whole = F.regexp_replace(F.input_file_name(), "^file:/+", "/")
    order = F.array_position(F.array(*[F.lit(quote(os.path.abspath(p))) for p in paths]), whole)
    rows = spark.read.schema(INDEX).json(paths, multiLine=True).select(order.alias("place"), F.posexplode("entries").alias("at", "e"))
    last = rows.groupBy(F.col("e.sessionId").alias("session_id")).agg(F.max_by("e", F.struct("place", "at")).alias("e"))
    moment = lambda c: F.try_to_timestamp(F.col(c)).cast("timestamp_ntz")
    return last.select("session_id", "e.summary", F.col("e.firstPrompt").alias("first_prompt"), F.col("e.messageCount").alias("message_count"), moment("e.created").alias("created"), moment("e.modified").alias("modified"), F.col("e.gitBranch").alias("git_branch"), F.col("e.projectPath").alias("project_path"))
