"""Continuous capture and upkeep."""

from __future__ import annotations

import os
import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.models import embed_udf
from ..functions.payload import record_text, text_udf
from ..operators.lake import Lake
from ..operators.sessions import derive_sessions, session_metadata
from ..operators.text_index import TextIndex
from ..operators.vector_index import VectorIndex
from ..schemas import TABLES
from ..sources.jsonl import complete_end, growing_ranges, lines_of, list_files, parse_records, read_lines, read_session_index

FTS_INTERVAL_S = 3600.0
SWEEP_INTERVAL = "300 seconds"


def capture(lake: Lake, lines: DataFrame, threshold: int = 100_000, index: DataFrame | None = None) -> dict[str, int]:
    """Sort lines into records, malformed lines and blobs; each line ends in one of the first two
    tables unless its key is known. Running it again adds nothing. ``seen`` counts records (S1).

    Of the tables, only files that may hold a key or a session of the batch are read. Sessions take
    their metadata from ``index`` where it has them (J15), from their records else."""
    now = int(time.time() * 1000)
    rows = parse_records(lines, threshold).persist()
    order = [F.col("file_path"), F.col("byte_offset")]
    good = rows.where("valid")
    bad = rows.where("not valid").select("file_path", "byte_offset", F.col("raw").alias("line_text"), F.lit(now).alias("ingested_at"))
    blobs = good.select("file_path", "byte_offset", "session_id", F.explode("blobs").alias("b")).select("file_path", "byte_offset", "session_id", "b.*")
    meta = blobs.select("file_path", "byte_offset", "file_id", "session_id", F.floor(F.length("content") / 4).cast("int").alias("token_count"), F.length("content").cast("int").alias("original_size"), F.lit(now).alias("created_at"))
    out = {"seen": good.count(), "blobs": lake.insert("blobs", blobs, order), "blob_meta": lake.insert("blob_meta", meta, order), "records": lake.insert("records", good, order), "malformed": lake.insert("malformed_lines", bad, order)}
    sessions = good.select("session_id").distinct().persist()
    own = lake.rows_by("records", sessions)
    lake.insert("sessions", derive_sessions(own, sessions) if index is None else session_metadata(sessions, index, own))
    sessions.unpersist()
    rows.unpersist()
    return out


def changed_files(lake: Lake, path: str) -> dict[str, int]:
    """Files whose time differs from the recorded one, with the offset to go on from."""
    known = {r.file_path: r for r in lake.table("file_mtimes").collect()}  # a row per file of the listing
    return {p: known[p].size_bytes if p in known else 0 for p in list_files(path) if p not in known or known[p].mtime_ns != os.stat(p).st_mtime_ns}


def capture_files(lake: Lake, path: str, threshold: int = 100_000, force: bool = False) -> dict[str, int]:
    """Read what is new in all changed files (or all files), then record how far it went."""
    known = {r.file_path: r.size_bytes for r in lake.table("file_mtimes").collect()}
    offsets = {p: known.get(p, 0) for p in list_files(path)} if force else changed_files(lake, path)
    total = {"seen": 0, "blobs": 0, "blob_meta": 0, "records": 0, "malformed": 0}
    if not offsets:
        return total
    marks = [(p, os.stat(p).st_mtime_ns, complete_end(p, at)) for p, at in offsets.items()]
    skip = {p: os.path.getsize(p) for p in list_files(path) if p not in offsets}
    total = capture(lake, read_lines(lake.spark, path, offsets | skip), threshold, session_index(lake.spark, offsets))
    lake.insert("file_mtimes", lake.spark.createDataFrame(marks, "file_path string, mtime_ns long, size_bytes long"))
    return total


def session_index(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """The index files beside transcripts."""
    return read_session_index(spark, sorted({os.path.dirname(p) for p in paths}))


def watch(spark: SparkSession, lake: Lake, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Capture files as they grow. How far each was read is state below the checkpoint; a batch
    that failed is repeated and adds nothing twice."""

    def batch(ranges: DataFrame, _: int) -> None:
        ranges = ranges.persist()
        folders = [r.d for r in ranges.select(F.regexp_replace("file_path", "/[^/]*$", "").alias("d")).distinct().collect()]  # projects with news
        if folders:
            capture(lake, lines_of(ranges, path), index=read_session_index(spark, sorted(folders)))
        ranges.unpersist()

    return growing_ranges(spark, path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def keep_up(spark: SparkSession, lake: Lake, embedder, checkpoint: str, trigger: dict | None = None, interval: float = FTS_INTERVAL_S) -> StreamingQuery:
    """The sweep again and again. A pass that fails is noted and the next one goes on with
    all that has no embedding yet, whatever came in between; the text index is due at most once an
    interval, and after a restart counts from its last commit. Passes are rows of ``sweeps``."""

    def batch(_: DataFrame, number: int) -> None:
        began = int(time.time() * 1000)
        try:
            done = sweep(lake, embedder, last_fts=last_rebuild(lake), interval=interval)
            note = (number, began, done["status"], sum(done.get(x, 0) for x in VECTOR_TABLES), done.get("fts"), None)
        except Exception as error:  # a model or a disk that fails now may be back for the next pass
            note = (number, began, "failed", None, None, next((x for x in reversed(str(error).splitlines()) if x.strip()), "")[:500])
        lake.insert("sweeps", spark.createDataFrame([(f"{checkpoint}:{number}", *note[1:])], TABLES["sweeps"].ddl))

    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    return ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": SWEEP_INTERVAL})).start()


def last_rebuild(lake: Lake) -> float | None:
    """When the last sweep rebuilt the text index, in seconds."""
    at = lake.table("sweeps").where("fts is not null").agg(F.max("began_ms")).first()[0]
    return None if at is None else at / 1000


def backfill(lake: Lake, embedder, limit: int | None = None) -> dict[str, int]:
    """Embed every record and summary that has no embedding, late ones included."""
    now, embed, out = int(time.time() * 1000), embed_udf(embedder), {}
    for table, target, key, text in (("records", "record_embeddings", "uuid", text_udf(record_text)(F.col("raw"))), ("summaries", "summary_embeddings", "summary_id", F.coalesce("content", F.lit("")))):
        todo = lake.table(table).join(lake.table(target).select(key), key, "left_anti").select(key, text.alias("text"))
        todo = todo.orderBy(key).limit(limit) if limit is not None else todo
        out[target] = lake.insert(target, todo.select(key, embed("text").alias("embedding"), F.lit(now).alias("embedded_at")))
    return out


def rebuild_fts(lake: Lake) -> int:
    """C11, K4: project all records to text and swap the snapshot."""
    return lake.replace("record_fts", record_texts(lake.table("records")))


#: Share of vectors beyond an index at which it is built anew.
STALE_SHARE = 0.2
VECTOR_TABLES = {"record_embeddings": "uuid", "summary_embeddings": "summary_id"}


def text_index(lake: Lake) -> TextIndex:
    return TextIndex(lake.spark, f"{lake.root}/text_index")


def vector_index(lake: Lake, table: str) -> VectorIndex:
    return VectorIndex(lake.spark, f"{lake.root}/{table}_index")


def record_texts(records: DataFrame) -> DataFrame:
    return records.select("uuid", text_udf(record_text)(F.col("raw")).alias("text"))


def sync_text(lake: Lake) -> int:
    """C11: the records of commits that the index has not seen, as a segment of their own."""
    index, commits = text_index(lake), lake.commits("records")
    fresh = [c for c in commits if c not in set(index.state()["covers"])]
    return index.add(record_texts(lake.read("records", fresh)), covers=fresh) if fresh else 0


def sync_vectors(lake: Lake, force: bool = False) -> dict[str, int]:
    """Build the index of a table anew once enough vectors lie beyond it; how many it holds then.
    Until then they are scanned beside it."""
    out = {}
    for table, key in VECTOR_TABLES.items():
        index, commits = vector_index(lake, table), lake.commits(table)
        state = index.state()
        beyond = [c for c in commits if c not in set(state.get("covers", ()))]
        held = int(index.cells().sizes.sum()) if state.get("folder") else 0
        if beyond and (force or lake.read(table, beyond).count() > STALE_SHARE * held):
            out[table] = index.build(lake.table(table), id_col=key, covers=commits)
    return out


def should_rebuild(force: bool, embedded: int, last: float | None, now: float, interval: float = FTS_INTERVAL_S, throttled: bool = True) -> bool:
    """X35, Z5."""
    if force:
        return True
    return embedded > 0 and (not throttled or last is None or now - last >= interval)


def sweep(lake: Lake, embedder, last_fts: float | None = None, force: bool = False, interval: float = FTS_INTERVAL_S) -> dict:
    """One upkeep pass, unless another is running."""
    with lake.single_flight("sweep") as mine:
        if not mine:
            return {"status": "already_running"}
        done = backfill(lake, embedder)
        rebuilt = should_rebuild(force, sum(done.values()), last_fts, time.time(), interval)
        if not rebuilt:
            return {"status": "done", **done, "fts": None}
        fts = rebuild_fts(lake)
        sync_text(lake)
        sync_vectors(lake, force)
        return {"status": "done", **done, "fts": fts}
