"""Streams into tables: each micro-batch becomes a segment, in exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.table import Mapper, Table
from ..schema import TemporalSchema
from ..sources.records import parse


def start_ingest(table: Table, stream: DataFrame, checkpoint: str, name: str = "ingest", interval: str | None = None, mapper: Mapper | None = None, retain: bool = False) -> StreamingQuery:
    """Append a stream's rows to a table.

    A batch that is run again after a failure has the same number and is in the manifest once at most.  Late rows are
    accepted and visible like any others; there is no watermark.  ``interval`` None processes what is there and ends.
    With ``retain`` old chunks are dropped by the table's settings, every ``Config.remove_interval_hours``.
    """

    def put(df: DataFrame, batch: int) -> None:
        table.append_batch(mapper(df) if mapper else df, name, batch)
        if retain:
            table.retain_due()

    writer = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def start_records(table: Table, stream: DataFrame, record: TemporalSchema, checkpoint: str, rejected_path: str, name: str = "records", interval: str | None = None, mapper: Mapper | None = None, **how) -> StreamingQuery:
    """Append JSON records (column ``value``); those that can't be read go to ``rejected_path``, each batch to a folder of its own."""

    def put(df: DataFrame, batch: int) -> None:
        found = parse(df, record, **how)
        found.rejected.write.mode("overwrite").parquet(f"{rejected_path}/batch={batch}")
        table.append_batch(mapper(found.rows) if mapper else found.rows, name, batch)

    writer = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def rate_limited(spark, rows_per_second: int) -> DataFrame:
    """A stream of numbered rows at a bounded rate."""
    if not 1 <= rows_per_second <= 100_000_000:
        raise ValueError("a rate is positive")
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


def windowed_counts(stream: DataFrame, time: str, window: str, late: str, by: str | None = None) -> DataFrame:
    """Counts of tumbling event-time windows, closed when the watermark passes them."""
    keys = [F.window(time, window)] + ([F.col(by)] if by else [])
    return stream.withWatermark(time, late).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
