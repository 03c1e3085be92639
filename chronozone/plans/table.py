"""Append-only tables of key-sorted chunks, with a manifest and a hot tier."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..functions.geo import Grid, Interval, Shape, coalesced
from ..functions.scalar import ipv4_value
from ..operators import partitioning
from ..operators.aggregates import Aggregate
from ..operators.predicates import Predicate
from ..operators.query import MANY, RangeQuery
from ..schema import TemporalSchema
from .files import Store
from .manifest import Conflict, Manifest, Version

Mapper = Callable[[DataFrame], DataFrame]


def _ordinal(name: str, kind: T.DataType):
    """A temporal value as a long: microseconds of timestamps, else itself."""
    c = F.col(name)
    return F.unix_micros(c.cast("timestamp")) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else c.cast("long")


class Table:
    """A stored table.  Rows are immutable; a query sees one version of the manifest and the hot rows of this process."""

    def __init__(self, spark: SparkSession, path: str, schema: TemporalSchema, mapper: Mapper | None = None, bloom_columns: Sequence[str] = (), config: Config | None = None, grid: Grid | None = None):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema.check()
        self.mapper, self.bloom_columns, self.config, self.grid = mapper, tuple(bloom_columns), config or Config(), grid
        self.manifest = Manifest(spark, f"{self.path}/_manifest")
        self._hot: list[DataFrame] = []
        self._retained: float | None = None

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: TemporalSchema, mapper: Mapper | None = None, bloom_columns: Sequence[str] = (), config: Config | None = None, grid: Grid | None = None) -> Table:
        made = cls(spark, path, schema, mapper, bloom_columns, config, grid)
        about = {"schema": schema.to_json(), "bloom": list(bloom_columns), "grid": list(vars(grid).values()) if grid else None}
        if not Store(spark, path).write("_table.json", json.dumps(about)):
            raise ValueError(f"there is a table at {path}")
        return made

    @classmethod
    def open(cls, spark: SparkSession, path: str, mapper: Mapper | None = None, config: Config | None = None) -> Table:
        about = json.loads(Store(spark, path).read("_table.json"))
        return cls(spark, path, TemporalSchema.from_json(about["schema"]), mapper, about["bloom"], config, Grid(*about["grid"]) if about["grid"] else None)

    # writing

    def _mapped(self, df: DataFrame) -> DataFrame:
        return self.schema.conform(self.mapper(df) if self.mapper else df)

    def _write(self, df: DataFrame, segment: str, tag: str = "") -> DataFrame:
        """Write key-sorted files and return their boxes, read from the two role columns alone."""
        key, ts = self.schema.index_field, self.schema.temporal_field
        # by time within a key, so a key with a large share of the rows is spread over files as well
        ordered = df.repartitionByRange(self.config.partitions, key, ts) if self.config.partitions else df.repartitionByRange(key, ts)
        out = ordered.sortWithinPartitions(key, ts).write.mode("overwrite").option("maxRecordsPerFile", self.config.chunk_rows).option("compression", self.config.codec)
        for c in self.bloom_columns:
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(self.config.bloom_entries)).option(f"parquet.bloom.filter.fpp#{c}", str(self.config.bloom_fpp))
        folder = f"{self.path}/data/{segment}"
        out.parquet(folder)
        kind = self.schema.struct[ts].dataType
        stored = self.spark.read.schema(self.schema.struct).parquet(folder)
        k, t = F.col(key).cast("double"), _ordinal(ts, kind)
        # a file with a null key or time has an open box, so nothing is pruned away with it
        low = lambda c, small: F.when(F.count(c) < F.count(F.lit(1)), F.lit(small)).otherwise(F.min(c))
        high = lambda c, large: F.when(F.count(c) < F.count(F.lit(1)), F.lit(large)).otherwise(F.max(c))
        return stored.groupBy(F.col("_metadata.file_path").alias("path")).agg(low(k, float("-inf")).alias("key_lo"), high(k, float("inf")).alias("key_hi"), low(t, -(2**63)).alias("ts_lo"), high(t, 2**63 - 1).alias("ts_hi"), F.count(F.lit(1)).alias("rows"), F.lit(tag).alias("tag"))

    def append(self, df: DataFrame, hot: bool = False) -> None:
        """Add rows.  ``hot`` keeps them in this session, visible to its queries, until ``flush``."""
        rows = self._mapped(df)
        if hot:
            self._hot.append(rows.cache() if self.config.hot_cache else rows)
            return
        segment = uuid.uuid4().hex
        self.manifest.add(self._write(rows, segment), segment)

    def append_batch(self, df: DataFrame, stream: str, batch: int) -> None:
        """Add a batch of a stream exactly once: one that is in already is skipped, and a broken one leaves no trace in the manifest."""
        if self.manifest.version().batches.get(stream, -1) >= batch:
            return
        segment = f"{stream}-{batch:012d}-{uuid.uuid4().hex[:8]}"
        self.manifest.add(self._write(self._mapped(df), segment, stream), segment, stream, batch)

    def flush(self) -> None:
        """Write the hot rows; they leave the hot tier once their version is there."""
        if self._hot:
            own, segment = list(self._hot), uuid.uuid4().hex
            self.manifest.add(self._write(reduce(DataFrame.unionByName, own), segment), segment)
            self._hot = self._hot[len(own) :]
            for df in own:
                df.unpersist()

    def _rewritten(self, change: Callable[[Version], Version | None], tries: int = 5) -> Version | None:
        """What ``change`` publishes from the newest version; tried again if another rewrite came between."""
        for _ in range(tries):
            try:
                return change(self.manifest.version())
            except Conflict:
                continue
        raise RuntimeError("other rewrites were always first")

    def compact(self, small_rows: int | None = None) -> None:
        """Rewrite chunks as one sorted segment; versions before still read the old files.

        With ``small_rows`` only segments of fewer rows are merged (if there are two or more), so the work follows what came in
        since; else all are.
        """

        def change(before: Version) -> Version | None:
            own = before.segments
            if small_rows is not None:
                sizes = self.manifest.sizes(before)
                own = [s for s in own if sizes.get(s, 0) < small_rows]
            if len(own) < (1 if small_rows is None else 2):
                return None
            segment = uuid.uuid4().hex
            return self.manifest.replace(self._write(self._cold(self.manifest.boxes(Version(-1, own))), segment), segment, own)

        self._rewritten(change)

    def retain(self, newest_before: Any = None, delete_files: bool = False) -> int:
        """Drop chunks whose newest row is older than a time (microseconds for timestamps); the number dropped.

        Without a time it is ``Config.keep_hours`` before the newest row of the table (longs are milliseconds).  Files stay for readers of older
        versions unless ``delete_files``; their names pass the driver a partition at a time.
        """
        dropped = 0

        def change(before: Version) -> Version | None:
            nonlocal dropped
            boxes = self.manifest.boxes(before)
            bound = newest_before
            if bound is None:
                # boxes left open by null times say nothing of the newest row
                newest = boxes.where(F.col("ts_hi") < 2**63 - 1).agg(F.max("ts_hi")).first()[0]
                bound = None if newest is None else newest - int(self.config.keep_hours * 3_600_000 * (1000 if self._timestamps() else 1))
            old = None if bound is None else boxes.where(F.col("ts_hi") < F.lit(bound)).select("path")
            dropped = 0 if old is None else old.count()
            if not dropped:
                return None
            made = self.manifest.replace(boxes.where(F.col("ts_hi") >= F.lit(bound)), uuid.uuid4().hex, before.segments)
            if delete_files:
                jvm, fs = self.spark.sparkContext._jvm, self.manifest.store.fs
                for r in old.toLocalIterator():
                    fs.delete(jvm.org.apache.hadoop.fs.Path(r.path), False)
            return made

        self._rewritten(change)
        return dropped

    def retain_due(self, delete_files: bool = False) -> int:
        """``retain`` by ``Config.keep_hours``, if ``Config.remove_interval_hours`` have passed since this process did so last."""
        now = time.monotonic()
        if self._retained is not None and now - self._retained < self.config.remove_interval_hours * 3600:
            return 0
        self._retained = now
        return self.retain(delete_files=delete_files)

    def balance(self, low: float, high: float, partitions: int) -> tuple[float, list[int] | None]:
        """The skew of key partitions of equal width over the stored rows, and a better plan if it exceeds ``Config.skew_threshold``
        (None if not, or without ``Config.load_balance``).  A plan assigns each of ``Config.intervals`` intervals to a partition."""
        own = partitioning.weights(partitioning.histogram(self.to_df(), self.schema.index_field, low, high, self.config.intervals), self.config.intervals)
        plan, load = partitioning.equal_plan(partitions, self.config.intervals), [0.0] * partitions
        for w, p in zip(own, plan):
            load[p] += w
        better = partitioning.rebalanced(own, plan, partitions, self.config.skew_threshold) if self.config.load_balance else None
        return partitioning.skew_factor(load), better

    # reading

    def _timestamps(self) -> bool:
        return isinstance(self.schema.struct[self.schema.temporal_field].dataType, (T.TimestampType, T.TimestampNTZType))

    def _cold(self, boxes: list[str] | DataFrame) -> DataFrame:
        """The rows of the files with these paths, or with these boxes if they are too many to name."""
        if isinstance(boxes, DataFrame):
            paths = [r.path for r in boxes.select("path").limit(self.config.listed_files + 1).collect()]
        else:
            paths = boxes
        if not paths:
            return self.spark.createDataFrame([], self.schema.struct)
        if isinstance(boxes, DataFrame) and len(paths) > self.config.listed_files:
            # read the segments' folders, a name each, and keep the files of this version
            folders = [r.f for r in boxes.select(F.regexp_replace("path", "/[^/]*$", "").alias("f")).distinct().collect()]
            df = self.spark.read.schema(self.schema.struct).parquet(*folders)
            return df.withColumn("__path", F.col("_metadata.file_path")).join(boxes.select(F.col("path").alias("__path")), "__path", "left_semi").drop("__path")
        return self.spark.read.schema(self.schema.struct).parquet(*paths)

    def _micros(self, t: Any) -> Any:
        """A bound of the temporal field as the long that boxes have."""
        if t is None or not self._timestamps():
            return t
        return self.spark.range(1).select(F.unix_micros(F.lit(t).cast("timestamp"))).first()[0]

    def scan(self, ranges: Iterable[tuple[Any, Any]] | None = None, start: Any = None, end: Any = None, version: Version | None = None) -> DataFrame:
        """Rows of all chunks that may meet the ranges, and the hot rows; not yet filtered."""
        lo, hi = self._micros(start), self._micros(end)
        found = self.manifest.select(ranges, lo, hi, version, self.config.listed_files)
        return reduce(DataFrame.unionByName, self._hot, self._cold(found))

    def to_df(self) -> DataFrame:
        return self.scan()

    def query(self) -> RangeQuery:
        return RangeQuery(self.schema.index_field, self.schema.temporal_field)

    def run(self, q: RangeQuery) -> DataFrame:
        return q.to_df(self.scan(q.ranges, q.start, q.end))

    def range_query(self, low: Any = None, high: Any = None, start: Any = None, end: Any = None, where: Predicate | None = None, having: Predicate | None = None, group_by: str | Sequence[str] | None = None, aggs: Sequence[Aggregate] = (), order_by: Sequence[Any] = (), hint: tuple[str, Any] | None = None) -> DataFrame:
        """The whole pipeline in one call; bounds are inclusive and None is unbounded."""
        return self.run(self._described(self.query().between(low, high), start, end, where, having, group_by, aggs, order_by, hint))

    @staticmethod
    def _described(q: RangeQuery, start, end, where, having, group_by, aggs, order_by, hint) -> RangeQuery:
        q = q.during(start, end).where(where).agg(group_by, *aggs).having(having).sort(*order_by)
        return q.hint(*hint) if hint else q

    def geo_query(self, shape: Shape, start: Any = None, end: Any = None, exact: bool = True, x: str = "longitude", y: str = "latitude", where: Predicate | None = None, having: Predicate | None = None, group_by: str | Sequence[str] | None = None, aggs: Sequence[Aggregate] = (), order_by: Sequence[Any] = (), hint: tuple[str, Any] | None = None) -> DataFrame:
        """Rows in a shape; the index field holds the grid's codes.  Without ``exact`` rows of all cells that the shape's box touches."""
        if not self.grid:
            raise ValueError("the table has no grid")
        found: list[Interval] = self.grid.intervals(shape.bbox())
        # with an exact shape the cells only prune: a few wide intervals will do
        q = RangeQuery(self.schema.index_field, self.schema.temporal_field, ranges=tuple(coalesced(found, MANY) if exact else found))
        if exact:
            q = q.where(shape.contains(x, y))
        return self.run(self._described(q, start, end, where, having, group_by, aggs, order_by, hint))

    def network_query(self, low_ip: str | int | None = None, high_ip: str | int | None = None, start: Any = None, end: Any = None, **more: Any) -> DataFrame:
        """Rows by a range of destination addresses, dotted or as signed numbers."""
        low, high = (ipv4_value(x) if isinstance(x, str) else x for x in (low_ip, high_ip))
        return self.range_query(low, high, start, end, **more)


class Catalog:
    """Named schemas; ``default`` is the table's own."""

    def __init__(self, spark: SparkSession, path: str, default: TemporalSchema | None = None):
        self.store = Store(spark, path)
        if default is not None:
            self.create_schema("default", default)

    def create_schema(self, name: str, schema: TemporalSchema | None) -> bool:
        """False if there is no schema given or the name is taken."""
        return schema is not None and self.store.write(f"schemas/{name}.json", schema.to_json())

    def get_schema(self, name: str = "default") -> TemporalSchema | None:
        return TemporalSchema.from_json(self.store.read(f"schemas/{name}.json")) if self.store.exists(f"schemas/{name}.json") else None

    def names(self) -> list[str]:
        return [n.removesuffix(".json") for n in self.store.names("schemas") if n.endswith(".json")]
