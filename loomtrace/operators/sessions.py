"""Sessions and whole-session payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.payload import first_prompt, record_text, text_udf
from ..functions.text import MARKER, blob_markers, timestamp_text


def derive_sessions(records: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """A1, A2, K3: a row per session from its records; wanted sessions without any get count 0.
    Only the records of wanted sessions are grouped."""
    if wanted is not None:
        wanted = wanted.select("session_id").distinct()
        records = records.join(wanted, "session_id", "left_semi")
    prompt = F.min_by(F.when(F.col("type") == "user", F.col("raw")), F.when(F.col("type") == "user", F.struct(F.col("timestamp").isNull(), "timestamp", "uuid")))
    found = records.groupBy("session_id").agg(prompt.alias("prompt"), F.count("*").cast("int").alias("message_count"), F.min("timestamp").alias("created"), F.max("timestamp").alias("modified"))
    if wanted is not None:
        found = wanted.join(found, "session_id", "left")
    none = F.lit(None).cast("string")
    return found.select("session_id", none.alias("summary"), text_udf(first_prompt)(F.col("prompt")).alias("first_prompt"), F.coalesce("message_count", F.lit(0)).alias("message_count"), "created", "modified", none.alias("git_branch"), none.alias("project_path"))


def session_metadata(wanted: DataFrame, index: DataFrame, records: DataFrame) -> DataFrame:
    """The index's row where there is one, else the derived one."""
    ids = wanted.select("session_id").distinct()
    return index.join(ids, "session_id", "left_semi").unionByName(derive_sessions(records, ids.join(index, "session_id", "left_anti")))


def count_by_type(records: DataFrame) -> DataFrame:
    """A3."""
    return records.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def chronological(records: DataFrame) -> DataFrame:
    """T6."""
    return records.orderBy(F.asc_nulls_last("timestamp"), "uuid")


def places(rows: DataFrame, by: str, order: list, folder: str) -> DataFrame:
    """W1, T6 for groups of any size: each row's ``place`` in its group from 1 and the group's ``size``.
    Rows are dealt by ranges of group and order, so a large group goes to several tasks; each counts its
    own, and the counts of the parts before are added. The sorted rows are kept below ``folder``, since
    ranges are drawn from a sample and would differ when computed again."""
    cut = rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    cut.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}).write.parquet(folder)
    held = rows.sparkSession.read.parquet(folder)
    parts = held.groupBy(by, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))  # a row per group and task
    of, before = W.partitionBy(by), W.partitionBy(by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(F.col(by).alias("_by"), F.col("_part").alias("_of"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"), F.sum("_n").over(of).alias("size"))
    joined = held.join(parts, (F.col("_part") == F.col("_of")) & F.col(by).eqNullSafe(F.col("_by")))
    return joined.withColumn("place", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_by", "_of", "_shift")


def page_after(rows: DataFrame, key: str, after: str | None, n: int) -> DataFrame:
    """The next n rows in order of a key, from behind the last one seen."""
    return (rows if after is None else rows.where(F.col(key) > after)).orderBy(key).limit(n)


def extent(rows: DataFrame, key: str) -> DataFrame:
    """A4: how many rows, and the greatest key."""
    return rows.agg(F.count("*").alias("n"), F.max(key).alias(f"max_{key}"))


def rehydrate(records: DataFrame, blobs: DataFrame) -> DataFrame:
    """X7 for any number of sessions: payloads with markers replaced by their blobs (as JSON strings, so the
    payload stays JSON), and ``missing_blobs``, the ids that have none. Records are told apart by uuid.

    A payload with markers is cut at them, each piece meets the blob behind it, and the pieces are put
    together in their order; all other payloads go along untouched."""
    has = F.coalesce(F.col("raw").rlike(MARKER), F.lit(False))
    none = F.array().cast("array<string>")
    plain = records.where(~has).withColumn("missing_blobs", none)
    marks = F.regexp_extract_all("raw", F.lit(f"({MARKER})"), F.lit(1))
    cut = F.arrays_zip(F.split("raw", MARKER, -1).alias("piece"), blob_markers(F.col("raw")).alias("file_id"), marks.alias("mark"))
    pieces = records.where(has).select("uuid", F.posexplode(cut).alias("place", "p")).select("uuid", "place", "p.piece", "p.file_id", "p.mark")
    escaped = F.expr("substring(j, 7, length(j) - 8)")  # between {"c":" and "}
    texts = blobs.select("file_id", F.to_json(F.struct(F.col("content").alias("c"))).alias("j")).where("j != '{}'").select("file_id", escaped.alias("blob"))
    filled = pieces.join(texts, "file_id", "left")
    part = F.struct("place", F.concat("piece", F.coalesce("blob", "mark", F.lit(""))).alias("text"))
    whole = filled.groupBy("uuid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["text"]), "").alias("_raw"), F.array_sort(F.collect_set(F.when(F.col("blob").isNull(), F.col("file_id")))).alias("missing_blobs"))
    return plain.unionByName(records.where(has).join(whole, "uuid").withColumn("raw", F.col("_raw")).drop("_raw"))


def full_session(records: DataFrame, blobs: DataFrame, session_id: str, include_blobs: bool = True) -> DataFrame:
    """C4: the session's records in order, markers replaced by their blobs, and what is missing."""
    own = records.where(F.col("session_id") == session_id)
    return chronological(rehydrate(own, blobs) if include_blobs else own.withColumn("missing_blobs", F.array().cast("array<string>")))


def missing_blobs(session: DataFrame) -> DataFrame:
    """The ids that a session refers to and the blob store lacks, distinct and in order. session:
    rows of ``full_session``."""
    return session.select(F.explode("missing_blobs").alias("file_id")).distinct().orderBy("file_id")


def session_text(session: DataFrame, session_id: str) -> str:
    """The session as one readable text."""
    rows = chronological(session.select("timestamp", "uuid", F.coalesce("type", F.lit("")).alias("type"), text_udf(record_text)(F.col("raw")).alias("text")))
    return f"# Session {session_id}\n\n" + "\n\n".join(f"## {r.type}\n\n{r.text}" for r in rows.toLocalIterator() if r.text)


def files_holding(lines: DataFrame, content_filter: str) -> DataFrame:
    """The ``file_path`` of files with a line that holds the text, whatever its case."""
    return lines.where(F.lower(F.col("line").cast("string")).contains(content_filter.lower())).select("file_path").distinct()


def matching_files(lines: DataFrame, content_filter: str) -> DataFrame:
    """Lines of files that hold the text anywhere."""
    return lines.join(files_holding(lines, content_filter), "file_path", "left_semi")


def payload_rows(session: DataFrame) -> DataFrame:
    """Rows of ``full_session`` as they go out, with their time as text."""
    return session.withColumn("timestamp", timestamp_text(F.col("timestamp")))
