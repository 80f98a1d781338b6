"""The driver's tables seen as transcript tables, once for Spark and once as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.files import shared_folder

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views of the tables a statement names."""
    for name in names or TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pad(c: str, n: int):
    return F.lpad(F.col(c).cast("string"), n, "0")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as records; ``raw`` is the text."""
    t = table(spark, sf_dir, "conversations")
    uuid = F.concat(F.lit("c"), _pad("conv_id", 8), F.lit("-"), _pad("turn", 4))
    zero = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    moment = zero + F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.col("conv_id").cast("int"), F.col("turn").cast("int"), F.lit(0))
    rows = t.select(uuid.alias("uuid"), F.concat(F.lit("s"), _pad("conv_id", 8)).alias("session_id"), F.col("role").alias("type"), moment.alias("timestamp"), F.col("text").alias("raw"), "conv_id", "turn")
    return rows.withColumn("parent_uuid", F.lag("uuid").over(W.partitionBy("session_id").orderBy("turn")))


def scratch(spark: SparkSession, label: str) -> str:
    return shared_folder(spark, label)


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table that retrieval reads, such as embeddings or postings: built once for a session
    and its input, then read from its files."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = scratch(spark, name)
        build().write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def json_records(recs: DataFrame) -> DataFrame:
    """The records with ``raw`` as the JSON of a transcript line."""
    message = F.struct(F.col("type").alias("role"), F.col("raw").alias("content"))
    return recs.withColumn("raw", F.to_json(F.struct("uuid", F.col("session_id").alias("sessionId"), "type", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), F.col("parent_uuid").alias("parentUuid"), message.alias("message"))))


def supersessions(recs: DataFrame) -> DataFrame:
    """Every tenth session supersedes the one before; every seventeenth record the one before."""
    sessions = recs.select("conv_id").distinct().where("conv_id % 10 = 0 and conv_id > 0").select(F.concat(F.lit("s"), _pad("conv_id", 8)).alias("superseding_id"), F.concat(F.lit("s"), F.lpad((F.col("conv_id") - 1).cast("string"), 8, "0")).alias("superseded_id"), F.lit("adr").alias("source"), (F.col("conv_id") * 1000).alias("created_at"))
    links = recs.where("(conv_id + turn) % 17 = 0 and parent_uuid is not null").select(F.col("uuid").alias("superseding_id"), F.col("parent_uuid").alias("superseded_id"), F.lit("record").alias("source"), (F.col("conv_id") * 1000 + F.col("turn")).alias("created_at"))
    return sessions.unionByName(links)


def summaries(recs: DataFrame, size: int = 4) -> DataFrame:
    """One sprig per full chunk of four user and assistant records: their texts."""
    from ..operators.summaries import full_chunks, summary_rows

    chunks = full_chunks(recs.where(F.col("type").isin("user", "assistant")), size)
    grouped = chunks.groupBy("session_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("turn", "uuid", "raw"))).alias("m"), F.min("conv_id").alias("conv_id"))
    rows = grouped.select("session_id", F.array_join(F.transform("m", lambda x: x["raw"]), " ").alias("content"), F.array().cast("array<string>").alias("parent_ids"), F.transform("m", lambda x: x["uuid"]).alias("message_uuids"), (F.col("conv_id") * 1000 + F.col("chunk")).alias("created_at"), F.array().cast("array<string>").alias("parent_files"))
    return summary_rows(rows, "sprig")


#: The same in DuckDB SQL, as the head of a WITH clause.
DUCK = """records AS (SELECT 'c' || lpad(CAST(conv_id AS VARCHAR), 8, '0') || '-' || lpad(CAST(turn AS VARCHAR), 4, '0') AS uuid, 's' || lpad(CAST(conv_id AS VARCHAR), 8, '0') AS session_id, role AS type, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id AS INTEGER)) + to_minutes(CAST(turn AS INTEGER)) AS timestamp, text AS raw, conv_id, turn, lag('c' || lpad(CAST(conv_id AS VARCHAR), 8, '0') || '-' || lpad(CAST(turn AS VARCHAR), 4, '0')) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_uuid FROM conversations),
supersessions AS (SELECT DISTINCT 's' || lpad(CAST(conv_id AS VARCHAR), 8, '0') AS superseding_id, 's' || lpad(CAST(conv_id - 1 AS VARCHAR), 8, '0') AS superseded_id, 'adr' AS source, conv_id * 1000 AS created_at FROM conversations WHERE conv_id % 10 = 0 AND conv_id > 0 UNION ALL SELECT uuid, parent_uuid, 'record', conv_id * 1000 + turn FROM records WHERE (conv_id + turn) % 17 = 0 AND parent_uuid IS NOT NULL),
numbered AS (SELECT *, (row_number() OVER (PARTITION BY session_id ORDER BY timestamp, uuid) - 1) // 4 AS chunk, count(*) OVER (PARTITION BY session_id) AS n FROM records WHERE type IN ('user', 'assistant')),
sprigs AS (SELECT session_id, chunk, string_agg(raw, ' ' ORDER BY turn) AS content, list(uuid ORDER BY turn) AS message_uuids, min(conv_id) * 1000 + chunk AS created_at FROM numbered WHERE chunk < n // 4 GROUP BY session_id, chunk),
summaries AS (SELECT 'sum_' || substr(sha256(content || CAST(created_at AS VARCHAR)), 1, 16) AS summary_id, session_id, 'sprig' AS kind, 1 AS condensation_order, content, greatest(1, length(content) // 4) AS token_count, message_uuids, created_at FROM sprigs)"""
