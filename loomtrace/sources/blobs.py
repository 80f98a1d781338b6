"""Large texts as files of their own, named by their content.

A blob's file lies in the folder of its first two digits. Tasks write theirs beside its place and move
it there, unless it is there already: content of one name is the same, so it never matters who comes
first, and a task that is repeated or lost leaves no half a file. Reading goes to the file of an id; no
table or folder is listed."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = re.compile(r"file_[0-9a-f]{16}")


def _system(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def _place(root: str, file_id: str) -> str:
    """X3. Only names of the contract are looked up, so an id never leads out of the folder."""
    if not NAME.fullmatch(file_id):
        raise ValueError(f"no blob id: {file_id!r}")
    return f"{root}/{file_id[5:7]}/{file_id}"


def write_blobs(blobs: DataFrame, root: str) -> DataFrame:
    """file_id, written: which of the blobs (file_id, content) were not there yet. Nulls are left out; it
    writes when the result is read, once for each id of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _system(root)
        for batch in batches:
            ids, new = batch.column("file_id").to_pylist(), []
            for file_id, content in zip(ids, batch.column("content").to_pylist()):
                path = _place(base, file_id)
                absent = system.get_file_info(path).type == fs.FileType.NotFound
                if absent:
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    part = f"{path}.{uuid.uuid4().hex}.tmp"
                    with system.open_output_stream(part) as out:
                        out.write(content.encode("utf-8", "surrogatepass"))
                    system.move(part, path)
                new.append(absent)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(new, pa.bool_())], names=["file_id", "written"])

    known = blobs.where("file_id is not null and content is not null").select("file_id", "content")
    return known.mapInArrow(run, "file_id string, written boolean")


def blob_reader(root: str):
    """An Arrow UDF from ids to contents; null for one that is not there or is no id."""

    @F.pandas_udf("string")
    def read(ids: pd.Series) -> pd.Series:
        system, base = _system(root)

        def content(file_id: str | None) -> str | None:
            try:
                with system.open_input_stream(_place(base, file_id or "")) as source:
                    return source.read().decode("utf-8", "replace")
            except (FileNotFoundError, ValueError):
                return None

        return pd.Series([content(x) for x in ids], dtype=object)

    return read


def register_reader(spark: SparkSession, root: str, name: str = "read_blob_file") -> None:
    """S19 as an SQL function."""
    spark.udf.register(name, blob_reader(root))
