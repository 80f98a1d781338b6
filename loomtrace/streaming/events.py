"""Event time: streams of events with a watermark (class P). State is kept by key and dropped once the
watermark has passed it, so it follows the width of the window, not the length of the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def timed(events: DataFrame, late: str, time_col: str = "ts") -> DataFrame:
    """Events with their time as event time, awaited for as long as ``late``."""
    return events.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late)


def once(events: DataFrame, key: list[str]) -> DataFrame:
    """The first of equal events that come within the watermark. events: those of ``timed``."""
    return events.dropDuplicatesWithinWatermark(key)


def sessions(events: DataFrame, key: str, gap: str, time_col: str = "ts") -> DataFrame:
    """Per key runs of events with no gap of that length: ``s`` (its begin) and ``n``."""
    found = events.groupBy(key, F.session_window(time_col, gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").cast("timestamp_ntz").alias("s"), "n")


def followed(causes: DataFrame, effects: DataFrame, key: str, within: str, time_col: str = "ts") -> DataFrame:
    """Pairs of a cause and an effect of the same key that came no more than ``within`` later; each of
    the streams is kept for as long as the other may still bring a partner. Columns of causes get the
    prefix ``cause_``."""
    left = causes.select(*[F.col(c).alias(f"cause_{c}") for c in causes.columns])
    near = (F.col(f"cause_{key}") == F.col(key)) & (F.col(f"cause_{time_col}") <= F.col(time_col)) & (F.col(f"cause_{time_col}") > F.col(time_col) - F.expr(f"INTERVAL {within}"))
    return effects.join(left, near)


def run_to_folder(rows: DataFrame, folder: str, mode: str = "append") -> StreamingQuery:
    """What there is, now, into Parquet below ``folder``. In mode complete a batch replaces the last."""
    out = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "complete":
        return out.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/rows")).start()
    return out.format("parquet").option("path", f"{folder}/rows").start()
