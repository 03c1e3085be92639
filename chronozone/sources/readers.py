"""Files, message queues and synthetic rows as frames, batch or streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.geo import Grid, Rectangle
from ..functions.scalar import ipv4_to_int, parse_millis

TRACE = "id int, datetime string, longitude double, latitude double"
TRACE_GRID = Grid(116.0, 117.0, 39.6, 40.6, 128)


def _reader(spark: SparkSession, streaming: bool, files_per_trigger: int | None):
    if not streaming:
        return spark.read
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else spark.readStream


def traces(spark: SparkSession, path: str, grid: Grid = TRACE_GRID, streaming: bool = False, files_per_trigger: int | None = None, replay: bool = False, loops: int = 1) -> DataFrame:
    """Trajectory points ``id, datetime, longitude, latitude`` within a grid's box, with ``zcode`` and ``timestamp`` in milliseconds.

    Lines that can't be read are left out; ``replay`` puts the present time in place of the recorded one, and ``loops`` gives
    every point so many times, as a driver does that begins the files again.
    """
    if loops < 1:
        raise ValueError("a trace is read once at least")
    rows = _reader(spark, streaming, files_per_trigger).schema(TRACE).option("mode", "DROPMALFORMED").csv(path)
    if loops > 1:
        rows = rows.withColumn("loop", F.explode(F.sequence(F.lit(1), F.lit(loops)))).drop("loop")
    inside = Rectangle(grid.x1, grid.y1, grid.x2, grid.y2).contains("longitude", "latitude")
    time = F.unix_millis(F.current_timestamp()) if replay else parse_millis("datetime")
    return rows.where(inside).select("id", grid.zcode("longitude", "latitude").cast("int").alias("zcode"), "longitude", "latitude", time.alias("timestamp"))


def network_log(spark: SparkSession, path: str, streaming: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """``source destination url`` lines with addresses dotted or as numbers, and the present time."""
    rows = _reader(spark, streaming, files_per_trigger).schema("a string, b string, url string").option("sep", " ").csv(path)
    number = lambda c: F.coalesce(F.col(c).try_cast("int"), ipv4_to_int(c))
    return rows.select(number("a").alias("sourceIP"), number("b").alias("destIP"), "url", F.unix_millis(F.current_timestamp()).alias("timestamp")).where("destIP is not null")


def messages(spark: SparkSession, servers: str, topic: str, streaming: bool = True, offsets_per_trigger: int | None = None, start: str = "earliest") -> DataFrame:
    """A topic's messages with their text in ``value``; needs the message-queue connector on Spark's class path."""
    reader = (spark.readStream if streaming else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", start)
    if streaming and offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", offsets_per_trigger)
    return reader.load().withColumn("value", F.col("value").cast("string"))


def _keyed(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in ("key", "value") if c in df.columns])


def send(df: DataFrame, servers: str, topic: str) -> None:
    """Write a frame's ``value`` (and ``key``, if there is one) to a topic."""
    _keyed(df).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def send_stream(df: DataFrame, servers: str, topic: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Write a stream's ``value`` (and ``key``) to a topic; ``interval`` None sends what is there and ends."""
    writer = _keyed(df).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def lines(spark: SparkSession, path: str, streaming: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """Text lines in ``value``."""
    return _reader(spark, streaming, files_per_trigger).text(path)
