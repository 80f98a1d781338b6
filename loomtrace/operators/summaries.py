"""The summary DAG."""

from __future__ import annotations

import logging
import subprocess
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.payload import fallback_summary, messages_text, tokens_of
from ..functions.scoring import estimate_tokens
from ..functions.text import file_ids, summary_id
from .sessions import places

# Fixed values of the summary contract.
CHUNK = 20
CONDENSE_AT = 4

ROW = "summary_id string, session_id string, kind string, condensation_order int, content string, token_count int, parent_ids array<string>, message_uuids array<string>, file_ids array<string>, created_at long"


def unsummarized(records: DataFrame, summaries: DataFrame) -> DataFrame:
    """User and assistant records that no summary covers."""
    covered = summaries.select(F.explode("message_uuids").alias("uuid")).distinct()
    return records.where(F.col("type").isin("user", "assistant")).join(covered, "uuid", "left_anti")


def uncondensed(summaries: DataFrame) -> DataFrame:
    """Sprigs that are no parent of a bindle."""
    used = summaries.where("kind = 'bindle'").select(F.explode("parent_ids").alias("summary_id")).distinct()
    return summaries.where("kind = 'sprig'").join(used, "summary_id", "left_anti")


def full_chunks(messages: DataFrame, size: int = CHUNK, folder: str | None = None) -> DataFrame:
    """Messages with their chunk; those of an unfinished last chunk are left out. With a folder
    for intermediate rows a long session is numbered by several tasks."""
    if folder:
        held = places(messages, "session_id", [F.asc_nulls_last("timestamp"), "uuid"], folder)
        return held.withColumn("chunk", F.floor((F.col("place") - 1) / size).cast("int")).where(F.col("chunk") < F.floor(F.col("size") / size)).drop("place", "size")
    w = W.partitionBy("session_id").orderBy(F.asc_nulls_last("timestamp"), "uuid")
    n = F.count("*").over(W.partitionBy("session_id"))
    numbered = messages.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size).cast("int")).withColumn("_n", n)
    return numbered.where(F.col("chunk") < F.floor(F.col("_n") / size)).drop("_n")


def condensable(summaries: DataFrame, at: int = CONDENSE_AT) -> DataFrame:
    """All open sprigs of sessions that have enough of them."""
    n = F.count("*").over(W.partitionBy("session_id"))
    return uncondensed(summaries).withColumn("_n", n).where(F.col("_n") >= at).drop("_n")


def latest_summary(summaries: DataFrame) -> DataFrame:
    """Per session that of the highest order, then the newest."""
    w = W.partitionBy("session_id").orderBy(F.desc("condensation_order"), F.desc("created_at"), "summary_id")
    return summaries.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def summary_rows(rows: DataFrame, kind: str) -> DataFrame:
    """Rows (session_id, content, parent_ids, message_uuids, created_at) with ids, token
    counts and the blob ids of the content and the parents (``parent_files``)."""
    own = F.array_sort(F.array_union(file_ids(F.col("content")), F.coalesce("parent_files", F.array().cast("array<string>"))))
    return rows.select(summary_id(F.col("content"), F.col("created_at")).alias("summary_id"), "session_id", F.lit(kind).alias("kind"), F.lit(1 if kind == "sprig" else 2).alias("condensation_order"), "content", estimate_tokens(F.col("content")).alias("token_count"), "parent_ids", "message_uuids", own.alias("file_ids"), "created_at")


def accepted(text: str, budget: int) -> bool:
    return bool(text.strip()) and budget > 1 and tokens_of(text.strip()) < budget


def escalate(source: str, previous: str, levels: tuple[Callable[[str, str], str], ...], budget: int | None = None) -> str:
    """The first level whose output is shorter than its input (``budget`` tokens, or as many as
    the source has); truncation at last. A level that fails or takes too long is passed over."""
    budget = tokens_of(source) if budget is None else budget
    for level in levels:
        try:
            text = level(source, previous)
        except (RuntimeError, OSError, ValueError, subprocess.SubprocessError) as error:
            logging.getLogger(__name__).warning("a level failed: %s", error)
            continue
        if accepted(text, budget):
            return text.strip()
    return fallback_summary(source, budget)


@dataclass(frozen=True)
class Command:
    """M3: a level that asks a program: the prompt on its standard input, the answer on its output.
    It is stopped after ``seconds``; another exit code than 0 is an error. NULs are dropped from both."""

    command: tuple[str, ...]
    instruction: str = ""
    seconds: float = 120.0

    def __call__(self, source: str, previous: str) -> str:
        prompt = "\n\n".join(x for x in (self.instruction, f"Summary so far:\n{previous}" if previous else "", source) if x)
        done = subprocess.run(self.command, input=prompt.replace("\0", "").encode(), capture_output=True, timeout=self.seconds, check=False)
        if done.returncode:
            raise RuntimeError(f"{self.command[0]} ended with {done.returncode}: {done.stderr.decode(errors='replace')[:500]}")
        return done.stdout.decode(errors="replace").replace("\0", "").strip()


def chunk_by_chunk(rows: Iterator[tuple], size: int) -> Iterator[tuple[str, int, list[tuple]]]:
    """Full chunks (session, number, rows) of rows that come session by session and in order, the
    session first; one chunk is held at a time, and an unfinished last one is left out."""
    session, number, held = object(), 0, []
    for row in rows:
        if row[0] != session:
            session, number, held = row[0], 0, []
        held.append(row)
        if len(held) == size:
            yield session, number, held
            number, held = number + 1, []


def make_sprigs(records: DataFrame, summaries: DataFrame, created_ms: int, levels: tuple = (), size: int = CHUNK) -> DataFrame:
    """One sprig per full chunk. A session's messages come to one task in order and pass
    through it: it holds one chunk and the summary before it, however long the session is. Sessions
    are independent."""
    rows = unsummarized(records, summaries).select("session_id", "uuid", "type", "raw", "timestamp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (tuple(r.values()) for b in batches for i in range(0, b.num_rows, 256) for r in b.slice(i, 256).to_pylist())
        previous = ""
        for session, number, chunk in chunk_by_chunk(stream, size):
            previous = escalate(messages_text([r[1:4] for r in chunk]), previous if number else "", levels)
            yield pa.RecordBatch.from_pylist([{"session_id": session, "content": previous, "message_uuids": [r[1] for r in chunk], "created_at": created_ms + number}], schema=made_as)

    made_as = pa.schema([("session_id", pa.string()), ("content", pa.string()), ("message_uuids", pa.list_(pa.string())), ("created_at", pa.int64())])
    ordered = rows.repartition("session_id").sortWithinPartitions("session_id", F.asc_nulls_last("timestamp"), "uuid").drop("timestamp")
    made = ordered.mapInArrow(run, "session_id string, content string, message_uuids array<string>, created_at long")
    none = F.array().cast("array<string>")
    return summary_rows(made.withColumns({"parent_ids": none, "parent_files": none}), "sprig")


def make_bindles(summaries: DataFrame, created_ms: int, levels: tuple = (), at: int = CONDENSE_AT) -> DataFrame:
    """One bindle of all open sprigs of a session that has enough."""
    parts = condensable(summaries, at).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "summary_id", "content", "file_ids"))).alias("p"), F.sum(F.coalesce("token_count", estimate_tokens(F.col("content")))).alias("tokens"))  # A9: stored counts, or counted anew

    @F.pandas_udf("string")
    def condense(texts: pd.Series, tokens: pd.Series) -> pd.Series:
        return pd.Series([escalate("\n\n".join(t), "", levels, int(n)) for t, n in zip(texts, tokens)], dtype=object)

    made = parts.select("session_id", condense(F.transform("p", lambda x: x["content"]), F.col("tokens")).alias("content"), F.transform("p", lambda x: x["summary_id"]).alias("parent_ids"), F.array().cast("array<string>").alias("message_uuids"), F.lit(created_ms).cast("long").alias("created_at"), F.array_distinct(F.flatten(F.transform("p", lambda x: x["file_ids"]))).alias("parent_files"))
    return summary_rows(made, "bindle")


def latest_summarized_session(summaries: DataFrame, file_mtimes: DataFrame, project_dir: str) -> DataFrame:
    """The session with the newest summary among those with a file in the project."""
    own = file_mtimes.where(F.col("file_path").startswith(project_dir)).select(F.regexp_extract("file_path", r"([^/]+)\.jsonl$", 1).alias("session_id")).where("session_id != ''").distinct()
    return summaries.join(own, "session_id", "left_semi").orderBy(F.desc("created_at"), "session_id").limit(1).select("session_id")


def session_context(records: DataFrame, summaries: DataFrame, blob_meta: DataFrame, session_id: str) -> DataFrame:
    """C5 as rows in order: section (bindle, sprig, tail, blob), id, text."""
    of = lambda df: df.where(F.col("session_id") == session_id)
    own = of(summaries)
    bindle = own.where("kind = 'bindle'").orderBy(F.desc("created_at"), "summary_id").limit(1).select(F.lit(0).alias("part"), F.lit("bindle").alias("section"), F.col("summary_id").alias("id"), F.col("content").alias("text"), F.col("created_at").cast("string").alias("at"))
    sprigs = uncondensed(own).select(F.lit(1).alias("part"), F.lit("sprig").alias("section"), F.col("summary_id").alias("id"), F.col("content").alias("text"), F.lpad(F.col("created_at").cast("string"), 20, "0").alias("at"))
    tail = unsummarized(of(records), own).select(F.lit(2).alias("part"), F.lit("tail").alias("section"), F.col("uuid").alias("id"), F.col("raw").alias("text"), F.coalesce(F.col("timestamp").cast("string"), F.lit("~")).alias("at"))
    blobs = of(blob_meta).select(F.lit(3).alias("part"), F.lit("blob").alias("section"), F.col("file_id").alias("id"), F.col("token_count").cast("string").alias("text"), F.lpad(F.col("created_at").cast("string"), 20, "0").alias("at"))
    return bindle.unionByName(sprigs).unionByName(tail).unionByName(blobs).orderBy("part", "at", "id").select("section", "id", "text")
