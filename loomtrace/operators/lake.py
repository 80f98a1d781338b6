"""Tables of a lake as Parquet folders.

A commit is a folder with rows and a folder with the key filters of its files (``keys``). Which commits
make up a table is a pointer that is replaced only by a writer that has seen its last value, so several
drivers may write and nothing is lost: a writer that comes second looks for its keys in what came
between, and goes on with the rest. An insert reads the files that may hold one of its keys, no others.

Rows with a known key are ignored (first wins) or, for tables that replace, every version is kept and
the newest read. With more than ``MOST_COMMITS`` the smallest commits are rewritten as one, in order of
the session or key, so the ranges of its files don't overlap. Folders that no kept version of the
pointer names are removed by ``vacuum``.

The root may be on any file system that Spark reaches."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import TABLES
from ..sources.files import Files
from . import keys
from .pointer import Pointer

VERSION = "_version"
#: Commits of a table before the smallest are put together, and how many of them at once.
MOST_COMMITS, COMPACTED = 12, 8
#: A lock that is older than this is a crashed run's.
LOCK_SECONDS = 6 * 3600.0


def first_per_key(rows: DataFrame, key: tuple[str, ...], order: list) -> DataFrame:
    """One row per key, the first in order."""
    w = W.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def new_rows(rows: DataFrame, existing: DataFrame, key: tuple[str, ...], order: list | None = None) -> DataFrame:
    """K1: rows whose key is new, one per key."""
    once = first_per_key(rows, key, order) if order else rows.dropDuplicates(list(key))
    return once.join(existing.select(*key), list(key), "left_anti")


class Lake:
    """One folder per table below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        #: Files that the last insert read to find known keys; None: all of them.
        self.files_read: int | None = 0

    def _pointer(self, name: str) -> Pointer:
        return Pointer(self.files, f"{self.root}/{name}/_log", [])

    def commits(self, name: str) -> list[str]:
        return [c["folder"] for c in self._pointer(name).read()[1]]

    def _write(self, name: str, rows: DataFrame) -> dict:
        """Rows and filters of a commit that no pointer names yet."""
        return self._filtered(name, self._rows(name, rows))

    def _rows(self, name: str, rows: DataFrame) -> str:
        """The folder of a commit that has no filters yet."""
        folder = f"commit-{uuid.uuid4().hex}"
        rows.write.option("maxRecordsPerFile", keys.FILE_ROWS).parquet(f"{self.root}/{name}/{folder}/rows")
        return folder

    def _filtered(self, name: str, folder: str) -> dict:
        path, t = f"{self.root}/{name}/{folder}", TABLES[name]
        by = {f"{path}/by": (t.by,)} if t.by else {}
        return {"folder": folder, "n": keys.write_filters(self.spark, f"{path}/rows", {**by, f"{path}/keys": t.key})}

    def _discard(self, name: str, commit: dict) -> None:
        self.files.remove(f"{self.root}/{name}/{commit['folder']}")

    def _ddl(self, name: str) -> str:
        t = TABLES[name]
        return f"{t.ddl}, {VERSION} long" if t.rule == "last" else t.ddl

    def read(self, name: str, commits: Sequence[str]) -> DataFrame:
        """The rows of some commits, all versions."""
        if not commits:
            return self.spark.createDataFrame([], self._ddl(name))
        return self.spark.read.schema(self._ddl(name)).parquet(*[f"{self.root}/{name}/{c}/rows" for c in commits])

    def table(self, name: str) -> DataFrame:
        """The table as it is now; of versions the newest."""
        rows = self.read(name, self.commits(name))
        return self._newest(name, rows)

    def _newest(self, name: str, rows: DataFrame) -> DataFrame:
        t = TABLES[name]
        return first_per_key(rows, t.key, [F.col(VERSION).desc()]).drop(VERSION) if t.rule == "last" else rows

    def rows_of(self, name: str, wanted: DataFrame) -> DataFrame:
        """The table's rows with the keys of a batch, from the files that may hold them."""
        t = TABLES[name]
        batch = wanted.select(*t.key).distinct()
        return self._newest(name, self._may_hold(name, self.commits(name), batch).join(batch, list(t.key), "left_semi"))

    def rows_by(self, name: str, wanted: DataFrame) -> DataFrame:
        """The same by the column that the table is also looked up by, such as the session."""
        by = TABLES[name].by
        batch = wanted.select(by).distinct()
        return self._newest(name, self._may_hold(name, self.commits(name), batch, "by").join(batch, by, "left_semi"))

    def _may_hold(self, name: str, commits: Sequence[str], batch: DataFrame, what: str = "keys") -> DataFrame:
        t = TABLES[name]
        found = keys.candidates(self.spark, [f"{self.root}/{name}/{c}/{what}" for c in commits], batch, t.key if what == "keys" else (t.by,))
        self.files_read = None if found is None else len(found)
        if found is None:
            return self.read(name, commits)
        return self.spark.read.schema(self._ddl(name)).parquet(*found) if found else self.read(name, [])

    def insert(self, name: str, rows: DataFrame, order: list | None = None) -> int:
        """Add the rows that are new by the table's rule; how many."""
        t, pointer = TABLES[name], self._pointer(name)
        if t.rule == "last":
            made = self._write(name, rows.select(*t.columns, F.lit(time.time_ns()).alias(VERSION)).where(F.col(t.key[0]).isNotNull()))
            if made["n"]:
                pointer.update(lambda now: [*now, made])
                self.compact(name, MOST_COMMITS)
            else:
                self._discard(name, made)
            return made["n"]
        once = first_per_key(rows, t.key, order) if order else rows.dropDuplicates(list(t.key))
        for k in t.key:
            once = once.where(F.col(k).isNotNull())
        # A batch that meets all files is joined as it is told apart, by the same shuffle. A smaller one is
        # written first, as its keys are looked at twice; it stays as it is if no file may hold one of them.
        left, seen, made, staged = once.select(*t.columns), set(), None, None
        try:
            while True:
                version, now = pointer.read()
                fresh = [c["folder"] for c in now if c["folder"] not in seen]
                if made is None or fresh:
                    every = made is None and bool(fresh) and keys.many(rows.select(*t.key))
                    if made:
                        left = self.read(name, [made["folder"]])
                    elif not every:
                        staged = self._rows(name, left)
                        left = self.read(name, [staged])
                    known = self.read(name, fresh) if every else self._may_hold(name, fresh, left)
                    self.files_read = None if every else self.files_read
                    if self.files_read != 0:
                        kept = left.join(known.select(*t.key), list(t.key), "left_anti")
                        before, made = made, self._write(name, kept)
                        if before:
                            self._discard(name, before)
                    elif made is None:
                        made, staged = self._filtered(name, staged), None
                    seen |= set(fresh)
                if not made["n"]:
                    self._discard(name, made)
                    return 0
                if pointer.swap(version, [*now, made]):
                    break
        finally:
            if staged:
                self._discard(name, {"folder": staged})
        self.compact(name, MOST_COMMITS)
        return made["n"]

    def replace(self, name: str, rows: DataFrame) -> int:
        """K4: write a snapshot, then point to it alone; a failed write leaves the old one."""
        made = self._write(name, rows.select(*TABLES[name].columns))
        self._pointer(name).update(lambda _: [made])
        return made["n"]

    def compact(self, name: str, most: int = 1) -> bool:
        """Put the smallest commits into one, in order of the key, if there are more than ``most``.
        Versions that no longer count go. Commits that others add meanwhile stay as they are."""
        now = self._pointer(name).read()[1]
        if len(now) <= most:
            return False
        small = sorted(now, key=lambda c: c["n"])[: max(2, len(now) if most == 1 else COMPACTED)]
        gone, t = {c["folder"] for c in small}, TABLES[name]
        rows = self.read(name, [c["folder"] for c in small])
        if t.rule == "last":
            rows = first_per_key(rows, t.key, [F.col(VERSION).desc()])
        files = max(1, -(-sum(c["n"] for c in small) // keys.FILE_ROWS))
        order = [*([t.by] if t.by else []), *t.key]
        made = self._write(name, rows.repartitionByRange(files, *order).sortWithinPartitions(*order))

        def change(commits: list[dict]) -> list[dict] | None:
            known = {c["folder"] for c in commits}
            return [made, *(c for c in commits if c["folder"] not in gone)] if gone <= known else None

        if made["folder"] in {c["folder"] for c in self._pointer(name).update(change)}:
            return True
        self._discard(name, made)  # another run was faster
        return False

    def vacuum(self, name: str, older_than: float = 24 * 3600.0) -> int:
        """Remove commits that no kept version names, once nobody can be reading or writing them."""
        pointer, now, removed = self._pointer(name), time.time(), 0
        named = {c["folder"] for v in pointer.versions() for c in json.loads(self.files.read(pointer._path(v)))}
        for folder in self.files.names(f"{self.root}/{name}"):
            path = f"{self.root}/{name}/{folder}"
            if folder.startswith("commit-") and folder not in named and (self.files.age_seconds(path, now) or 0) > older_than:
                self.files.remove(path)
                removed += 1
        return removed

    def register_views(self) -> None:
        for name in TABLES:
            self.table(name).createOrReplaceTempView(name)
        # Takes any column; planned as a join with the blobs.
        self.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION read_blob(id STRING) RETURNS STRING RETURN (SELECT max(content) FROM blobs WHERE file_id = id)")

    def describe(self) -> str:
        """The tables and their columns."""
        return "\n".join(f"{name}({TABLES[name].ddl})" for name in sorted(TABLES))

    def migrate(self) -> bool:
        """Once per lake, history gets its key, nameless records go, and all files are read again."""
        if self.table("schema_meta").where("key = 'capture_version' and value = '2'").limit(1).count():
            return False
        self.replace("history", self.table("history").dropDuplicates(["timestamp", "session_id"]))
        self.replace("records", self.table("records").where("uuid != ''"))
        self._pointer("file_mtimes").update(lambda _: [])
        self.insert("schema_meta", self.spark.createDataFrame([("capture_version", "2")], "key string, value string"))
        return True

    @contextmanager
    def single_flight(self, job: str, stale_after: float = LOCK_SECONDS) -> Iterator[bool]:
        """False if another run of the job holds its lock. The lock of a run that crashed counts
        until it is ``stale_after`` seconds old."""
        lock, mine = f"{self.root}/{job}.lock", json.dumps({"run": uuid.uuid4().hex})
        age = self.files.age_seconds(lock, time.time())
        if age is not None and age > stale_after:
            self.files.remove(lock)
        if not self.files.put_new(lock, mine):
            yield False
            return
        try:
            yield True
        finally:
            self.files.remove(lock)
