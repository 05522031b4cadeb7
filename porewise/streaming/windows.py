"""Sessions and sliding windows of events by their own time, in a batch or over a stream with late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.storage import new_folder


def _measures(value: str) -> list[Column]:
    return [F.count("*").alias("events"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.sum(value).alias("total")]


def sessions(events: DataFrame, gap: str = "30 minutes", key: str = "user_id", value: str = "value") -> DataFrame:
    """(key, first, last, events, total): a session ends ``gap`` after its last event. A null key is a key; a null time is in no session."""
    found = events.where("ts is not null").groupBy(F.session_window("ts", gap), key).agg(*_measures(value))
    return found.select(key, "first", "last", "events", "total")


def sliding(events: DataFrame, length: str = "1 hour", slide: str = "15 minutes", key: str = "event_type", value: str = "value") -> DataFrame:
    """(key, start, events, first, last, total) of every window that has events; windows begin every ``slide``."""
    found = events.where("ts is not null").groupBy(F.window("ts", length, slide), key).agg(*_measures(value))
    return found.select(key, F.col("window.start").alias("start"), "first", "last", "events", "total")


def with_lateness(events: DataFrame, delay: str) -> DataFrame:
    """What a stream may forget: rows whose windows end before the newest time less ``delay`` are dropped and counted.

    The newest time is that of the batches up to the one before the last, so a batch never drops its own rows.
    State holds the open windows only: of each key, those whose end the watermark has not passed.
    """
    return events.withWatermark("ts", delay)


def write_to_end(stream: DataFrame, name: str, trigger: dict | None = None, out: str | None = None) -> tuple[DataFrame, StreamingQuery]:
    """Run a stream over all that has arrived and return the table that it wrote, with the ended query.

    Only windows that the watermark has passed are written, each once. The table and the state lie in
    the shared folder, so a lost executor goes on from the last batch, as does the same stream that is
    given the folder ``out`` again.
    """
    spark = stream.sparkSession
    out = out or new_folder(spark, name)
    query = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows"), query


def state_of(query: StreamingQuery) -> dict[str, int]:
    """Of a query's batches: rows dropped as too late in all, the most rows that the state held at once, and how many batches."""
    batches = [p for p in query.recentProgress if p.stateOperators]
    return {
        "late": sum(s.numRowsDroppedByWatermark for p in batches for s in p.stateOperators),
        "most_state": max((s.numRowsTotal for p in batches for s in p.stateOperators), default=0),
        "batches": len(query.recentProgress),
    }
