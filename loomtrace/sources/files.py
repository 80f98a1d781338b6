"""Small files of any file system that Spark reaches: pointers, marks, listings.

Plain and ``file:`` paths are handled by the operating system, all others by the session's Hadoop
file systems."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new name in the folder that driver and executors share (``spark.checkpoint.dir``); in one
    process without one, in a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="loomtrace-")
    return re.sub("^file:/+", "/", root.rstrip("/")) + f"/{label}-{uuid.uuid4().hex}"


class Files:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._plain_is_local = str(spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")).startswith("file:")

    def local(self, path: str) -> str | None:
        """The path of the operating system, if it is one."""
        if path.startswith("file:"):
            return re.sub("^file:/+", "/", path)
        return path if "://" not in path and self._plain_is_local else None

    def _remote(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def names(self, folder: str) -> list[str]:
        """What lies in a folder, sorted; nothing if there is no such folder."""
        if own := self.local(folder):
            return sorted(os.listdir(own)) if os.path.isdir(own) else []
        system, where = self._remote(folder)
        return sorted(x.getPath().getName() for x in system.listStatus(where)) if system.exists(where) else []

    def read(self, path: str) -> str:
        if own := self.local(path):
            with open(own, encoding="utf-8") as source:
                return source.read()
        system, where = self._remote(path)
        stream = system.open(where)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_new(self, path: str, text: str) -> bool:
        """Write a file unless one of that name is there. Readers see the whole of it or nothing, and
        of several writers one wins: by a link, or a rename that does not replace."""
        part = f"{path}.{uuid.uuid4().hex}.tmp"
        if own := self.local(path):
            part = self.local(part)
            os.makedirs(os.path.dirname(own), exist_ok=True)
            with open(part, "w", encoding="utf-8") as out:
                out.write(text)
            try:
                os.link(part, own)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(part)
        system, where = self._remote(path)
        temporary = self._remote(part)[1]
        stream = system.create(temporary, False)
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        done = not system.exists(where) and system.rename(temporary, where)
        if not done:
            system.delete(temporary, False)
        return done

    def remove(self, path: str) -> None:
        """A file or a folder with all in it, if it is there."""
        if own := self.local(path):
            if os.path.isdir(own):
                shutil.rmtree(own, ignore_errors=True)
            elif os.path.exists(own):
                os.unlink(own)
            return
        system, where = self._remote(path)
        system.delete(where, True)

    def size(self, path: str) -> int:
        """Bytes of all files below a path, or 0 if it isn't there."""
        system, where = self._remote(path)
        return system.getContentSummary(where).getLength() if system.exists(where) else 0

    def age_seconds(self, path: str, now: float) -> float | None:
        """Since its last change; None if it isn't there."""
        if own := self.local(path):
            return now - os.stat(own).st_mtime if os.path.exists(own) else None
        system, where = self._remote(path)
        return now - system.getFileStatus(where).getModificationTime() / 1000 if system.exists(where) else None
