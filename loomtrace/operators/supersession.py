"""Supersession links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lake import Lake


LINK = "superseding_id string, superseded_id string, source string"


def add_links(lake: Lake, links: Sequence[tuple[str, str, str]] | DataFrame, created_ms: int) -> int:
    """Add a batch of (superseding, superseded, source), a list or rows; a link to itself fails the
    whole batch."""
    rows = links if isinstance(links, DataFrame) else lake.spark.createDataFrame(list(links), LINK)
    if not rows.where("superseding_id = superseded_id").limit(1).isEmpty():
        raise ValueError("a link may not supersede itself")
    return lake.insert("supersessions", rows.select("superseding_id", "superseded_id", "source", F.lit(created_ms).cast("long").alias("created_at")))


def is_superseded(links: DataFrame, item: str) -> bool:
    return not links.where(F.col("superseded_id") == item).limit(1).isEmpty()


def superseded_ids(links: DataFrame) -> DataFrame:
    return links.select("superseded_id").distinct()


def superseded_sessions(links: DataFrame, records: DataFrame) -> DataFrame:
    """Superseded ids that are sessions."""
    return superseded_ids(links).join(records.select(F.col("session_id").alias("superseded_id")).distinct(), "superseded_id", "left_semi")


def ranked_links(links: DataFrame) -> DataFrame:
    """T8 for all items: each link's ``place`` among those that supersede the same item, newest first."""
    return links.withColumn("place", F.row_number().over(W.partitionBy("superseded_id").orderBy(F.desc("created_at"), "superseding_id")))


def links_for(links: DataFrame, item: str) -> DataFrame:
    """What supersedes an item, newest first."""
    return links.where(F.col("superseded_id") == item).orderBy(F.desc("created_at"), "superseding_id")
