"""Streaming twins of the lookup, the recurrence flags and the late evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridpanel.operators.lookup import lookup_job


def _available(df: DataFrame, checkpoint: str, batch) -> StreamingQuery:
    query = (
        df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def _append_once(out: str):
    """Writer whose batch folder is named by its id, so a replayed batch replaces itself."""
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return write


def lookup_stream(requests: DataFrame, cells: DataFrame, size: float, out: str, checkpoint: str, key: str = "event_id", square: bool = False) -> StreamingQuery:
    """Answer a stream of requests against static scores; every batch is the batch lookup."""
    write = _append_once(out)

    def batch(df: DataFrame, i: int) -> None:
        df.persist()  # the lookup reads its requests several times
        write(lookup_job(df, cells, size, key, square), i)
        df.unpersist()

    return _available(requests, checkpoint, batch)


def recurrence_stream(events: DataFrame, key: str, event_id: str, ts: str = "ts", window: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Hits per cell and window with bounded state: repeats dropped, late events beyond ``delay`` ignored."""
    clean = events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([event_id])
    return clean.groupBy(F.window(ts, window), key).agg(F.count(F.lit(1)).alias("events")).select(
        key, F.col("window.start").alias("window_start"), "events", F.lit(True).alias("hit")
    )


def recurrence_batch(events: DataFrame, key: str, event_id: str, ts: str = "ts", window: str = "1 day") -> DataFrame:
    """The same flags over a finished table."""
    clean = events.groupBy(event_id).agg(F.min(F.struct(ts, key)).alias("e")).select(event_id, "e.*")
    return clean.groupBy(F.window(ts, window), key).agg(F.count(F.lit(1)).alias("events")).select(
        key, F.col("window.start").alias("window_start"), "events", F.lit(True).alias("hit")
    )


def write_stream(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append closed windows to Parquet until the available input is used up."""
    query = (
        df.writeStream.format("parquet").outputMode("append").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def label_arrival(outcomes: DataFrame, scores: DataFrame, out: str, checkpoint: str, keys: Sequence[str] = ("cell_id", "forecast_year")) -> StreamingQuery:
    """Evaluate published scores as outcomes arrive: ``(keys…, score, target)`` for every score of an arrived year.

    The last key is the year. Scores without an outcome in an arrived year have the target 0.
    Arrived rows are kept beside the checkpoint, so a year that arrives in parts is evaluated
    anew with all of its parts.
    """
    year, landed = keys[-1], f"{checkpoint}-arrived"
    log = _append_once(landed)

    def batch(df: DataFrame, i: int) -> None:
        df.persist()
        log(df, i)
        years = df.select(year).distinct()
        known = df.sparkSession.read.parquet(landed).select(*keys, F.col("share").alias("target"))
        told = scores.join(years, year, "left_semi").join(known, list(keys), "left").withColumn("target", F.coalesce("target", F.lit(0.0)))
        told.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(year).parquet(out)
        df.unpersist()

    return _available(outcomes, checkpoint, batch)


