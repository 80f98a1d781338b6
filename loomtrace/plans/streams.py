"""The events table as a stream: what is left at its end equals SQL over the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import events as E
from . import views as V
from .passthrough import STATEMENTS
from .reference import QUERIES, SQL, query

__all__ = ["QUERIES", "SQL"]


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A pattern: a stream's plain path must be a folder, the table may be one file.
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/event[s].parquet")


def _done(spark: SparkSession, rows: DataFrame, mode: str = "append") -> DataFrame:
    folder = V.scratch(spark, "stream")
    E.run_to_folder(rows, folder, mode).awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


@query("SELECT event_id, user_id, event_type FROM events", views=False)
def e_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event comes twice and is kept once."""
    twice = _stream(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return _done(spark, E.once(E.timed(twice, "10 minutes"), ["event_id"]).select("event_id", "user_id", "event_type"))


@query(STATEMENTS["p_session"][-1], views=False)
def e_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows of a user's events."""
    return _done(spark, E.sessions(E.timed(_stream(spark, sf_dir), "1 hour"), "user_id", "6 hours"), "complete")


@query("SELECT c.event_id AS click, p.event_id AS purchase, c.user_id FROM events p JOIN events c ON p.event_type = 'purchase' AND c.event_type = 'click' AND p.user_id = c.user_id AND c.ts <= p.ts AND c.ts > p.ts - INTERVAL '1 hour'", views=False)
def e_followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams joined: clicks, and purchases within an hour of them."""
    every = _stream(spark, sf_dir)
    clicks, purchases = (E.timed(every.where(F.col("event_type") == kind).select("event_id", "user_id", "ts"), "2 hours") for kind in ("click", "purchase"))
    found = E.followed(clicks, purchases, "user_id", "1 HOUR")
    return _done(spark, found.select(F.col("cause_event_id").alias("click"), F.col("event_id").alias("purchase"), "user_id"))
