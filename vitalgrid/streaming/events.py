"""The batch normalizer on a stream, and event counts by event time.

An extension: the normalizer is one row-local projection, so it runs unchanged
on ``readStream``. The row number must be a column of the source.

``keyed_events`` drops repeats of an event inside a watermark of its arrival, and
``merge_batches`` merges what is left into a keyed table by event id. The number of
the last batch stands in the same manifest as its rows, so a batch that is run
again after a failure changes nothing, and repeats that come after the watermark replace their
own row. Counts over the table are those of the batch query over all events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.operators.fields import valid_event
from vitalgrid.operators.normalize import normalize_events
from vitalgrid.plans.keyed_table import KeyedTable
from vitalgrid.schemas import NORMALIZED_EVENTS


def normalized_stream(raw: DataFrame, row_index: str, manifest_hash: str = "") -> DataFrame:
    return normalize_events(raw, manifest_hash, row_index=row_index)


def windowed_counts(events: DataFrame, watermark: str = "30 days", width: str = "30 days", geography: str = "residence") -> DataFrame:
    """Events per area and window of the death date; rows later than the watermark are left out."""
    kept = events.where(valid_event(geography)).select(F.col("death_date").try_cast("timestamp").alias("event_time"), F.col(f"mun_{geography}_cod6").alias("municipality_cod6"))
    grouped = kept.withWatermark("event_time", watermark).groupBy(F.window("event_time", width), "municipality_cod6")
    return grouped.agg(F.count(F.lit(1)).alias("death_count")).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "municipality_cod6", "death_count")


def keyed_events(events: DataFrame, arrived: str, watermark: str = "1 hour") -> DataFrame:
    """Events without repeats of an id that arrive within the watermark; ``arrived`` is a timestamp column of the stream."""
    return events.withWatermark(arrived, watermark).dropDuplicatesWithinWatermark(["event_id"])


def event_table(spark: SparkSession, folder: str) -> KeyedTable:
    return KeyedTable(spark, folder, NORMALIZED_EVENTS, ["event_id"]).create()


def merge_batches(table: KeyedTable, query: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch of the named query goes into the table once."""

    def put(batch: DataFrame, number: int) -> None:
        if table.manifest().get("marks", {}).get(query, -1) < number:
            table.merge(batch, {query: number})

    return put
