"""Files in the folder that the driver and all executors share.

The folder is the session's ``spark.checkpoint.dir``. Only where it is unset and Spark runs
in one process (tests) is a temporary folder made and set.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The URI of the shared folder of this session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="loomtrace-")
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A name that nobody else uses, below the shared folder."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: later plans start at the files,
    so they cost no recomputation and survive the loss of executors."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; plain paths are local."""
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri)


def write_bytes(uri: str, *parts: bytes) -> None:
    """Write a whole file under a temporary name, then move it into place."""
    system, path = filesystem(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(part) as out:
        for data in parts:
            out.write(data)
    system.move(part, path)


def remove(uri: str) -> None:
    """Delete a folder of intermediate results."""
    system, path = filesystem(uri)
    system.delete_dir(path)


def read_bytes(uri: str) -> bytes:
    system, path = filesystem(uri)
    with system.open_input_stream(path) as source:
        return source.read()
