"""The registered queries of the engine over the test tables, and their SQL equivalents."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar
from ..functions.geo import Circle, Grid, Polygon, Rectangle
from ..operators import partitioning
from ..operators.aggregates import Avg, Count, Custom, Max, Min, Sum
from ..operators.predicates import all_equal, compare
from ..operators.query import RangeQuery, page
from ..schema import TemporalSchema
from ..sources import generators, records
from ..streaming.ingest import start_ingest, start_records
from .. import services
from .files import Store
from .table import Table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
GRID = Grid(111.0, 115.0, 21.0, 26.0, 128)
LINES, EVENTS = RangeQuery("l_orderkey", "l_shipdate"), RangeQuery("user_id", "ts")


def _query(sql: str | None = None):
    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return put


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


@lru_cache(maxsize=8)
def _own_folder(application: str) -> str:
    """A temporary folder of a session in local mode."""
    return Path(tempfile.mkdtemp(prefix=f"chronozone-{application}-")).as_uri()


def _folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_folder(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"


_MADE: dict[tuple[str, ...], str] = {}


def _kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[str], Table], **how) -> Table:
    """A stored table that queries only read, made once in a session."""
    own = spark.sparkContext.applicationId, str(spark.conf.get("spark.checkpoint.dir", None)), sf_dir, name
    if own not in _MADE or not Store(spark, _MADE[own]).exists("_table.json"):
        _MADE[own] = make(_folder(spark)).path
    return Table.open(spark, _MADE[own], **how)


# key and time ranges


@_query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem WHERE l_orderkey BETWEEN 100 AND 9000")
def key_range(spark, sf_dir):
    return LINES.between(100, 9000).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").to_df(_read(spark, sf_dir, "lineitem"))


@_query("SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_orderkey BETWEEN 100 AND 9000 AND l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31'")
def key_time_range(spark, sf_dir):
    return LINES.between(100, 9000).during(_ntz("1995-01-01"), _ntz("1995-12-31")).select("l_orderkey", "l_linenumber", "l_shipdate").to_df(_read(spark, sf_dir, "lineitem"))


@_query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey BETWEEN 100 AND 9000 AND l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31' GROUP BY l_returnflag")
def range_group_agg(spark, sf_dir):
    return LINES.between(100, 9000).during(_ntz("1995-01-01"), _ntz("1995-12-31")).agg("l_returnflag", Count(alias="n")).to_df(_read(spark, sf_dir, "lineitem"))


@_query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 7")
def point_key(spark, sf_dir):
    return LINES.between(7, 7).select("l_orderkey", "l_linenumber", "l_quantity").to_df(_read(spark, sf_dir, "lineitem"))


@_query("SELECT l_orderkey, l_linenumber FROM lineitem")
def unbounded(spark, sf_dir):
    return LINES.between().during().select("l_orderkey", "l_linenumber").to_df(_read(spark, sf_dir, "lineitem"))


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey BETWEEN 10 AND 5")
def empty_range(spark, sf_dir):
    return LINES.between(10, 5).select("l_orderkey", "l_linenumber").to_df(_read(spark, sf_dir, "lineitem"))


@_query("SELECT event_id, user_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06'")
def time_only(spark, sf_dir):
    return EVENTS.during(_ntz("2024-01-05"), _ntz("2024-01-06")).select("event_id", "user_id").to_df(_read(spark, sf_dir, "events"))


@_query("SELECT count(*) AS n, round(sum(value), 4) AS s FROM events WHERE user_id BETWEEN 5 AND 9 OR user_id BETWEEN 40 AND 44")
def many_ranges(spark, sf_dir):
    q = RangeQuery("user_id", "ts", ranges=((5, 9), (40, 44)))
    return q.agg(None, Count(alias="n"), Sum("value", "s")).to_df(_read(spark, sf_dir, "events")).withColumn("s", F.round("s", 4))


# aggregates


@_query("SELECT count(*) AS n, round(sum(value), 4) AS s, min(value) AS lo, max(value) AS hi FROM events WHERE user_id BETWEEN 10 AND 60")
def scalar_agg(spark, sf_dir):
    return EVENTS.between(10, 60).agg(None, Count(alias="n"), Sum("value", "s"), Min("value", "lo"), Max("value", "hi")).to_df(_read(spark, sf_dir, "events")).withColumn("s", F.round("s", 4))


@_query("SELECT count(*) AS n, sum(value) AS s, min(value) AS lo, max(value) AS hi FROM events WHERE user_id BETWEEN 60 AND 10")
def scalar_agg_empty(spark, sf_dir):
    return EVENTS.between(60, 10).agg(None, Count(alias="n"), Sum("value", "s"), Min("value", "lo"), Max("value", "hi")).to_df(_read(spark, sf_dir, "events"))


@_query("SELECT event_type, count(*) AS n FROM events WHERE user_id BETWEEN 60 AND 10 GROUP BY event_type")
def group_agg_empty(spark, sf_dir):
    return EVENTS.between(60, 10).agg("event_type", Count(alias="n")).to_df(_read(spark, sf_dir, "events"))


@_query('SELECT user_id, count(*) AS "count(*)", round(sum(value), 4) AS "sum(value)", min(value) AS "min(value)", max(value) AS "max(value)" FROM events GROUP BY user_id')
def all_aggs(spark, sf_dir):
    return EVENTS.agg("user_id", Count(), Sum("value"), Min("value"), Max("value")).to_df(_read(spark, sf_dir, "events")).withColumn("sum(value)", F.round(F.col("`sum(value)`"), 4))


@_query("SELECT event_type, round(avg(value), 4) AS mean FROM events GROUP BY event_type")
def avg_agg(spark, sf_dir):
    return EVENTS.agg("event_type", Avg("value", "mean")).to_df(_read(spark, sf_dir, "events")).withColumn("mean", F.round("mean", 4))


@_query("SELECT l_quantity, count(*) AS n FROM lineitem WHERE l_orderkey BETWEEN 0 AND 5000 GROUP BY l_quantity")
def group_double(spark, sf_dir):
    return LINES.between(0, 5000).agg("l_quantity", Count(alias="n")).to_df(_read(spark, sf_dir, "lineitem"))


@_query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus")
def multi_group(spark, sf_dir):
    return LINES.agg(["l_returnflag", "l_linestatus"], Count(alias="n"), Sum("l_quantity", "q")).to_df(_read(spark, sf_dir, "lineitem")).withColumn("q", F.round("q", 2))


@_query("SELECT CASE WHEN event_type = 'click' THEN NULL ELSE event_type END AS kind, count(*) AS n FROM events GROUP BY 1")
def null_group(spark, sf_dir):
    df = _read(spark, sf_dir, "events").withColumn("kind", F.when(F.col("event_type") != "click", F.col("event_type")))
    return EVENTS.agg("kind", Count(alias="n")).to_df(df)


@_query("SELECT DISTINCT event_type FROM events WHERE user_id BETWEEN 0 AND 20")
def distinct_groups(spark, sf_dir):
    return EVENTS.between(0, 20).agg("event_type").to_df(_read(spark, sf_dir, "events"))


@_query("SELECT user_id, count(*) AS n, max(value) AS hi FROM events GROUP BY user_id HAVING max(value) < 200")
def having(spark, sf_dir):
    return EVENTS.agg("user_id", Count(alias="n"), Max("value", "hi")).having(F.col("hi") < 200).to_df(_read(spark, sf_dir, "events"))


@_query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) < 0")
def having_no_match(spark, sf_dir):
    return EVENTS.agg("user_id", Count(alias="n")).having("n < 0").to_df(_read(spark, sf_dir, "events"))


@_query("SELECT event_id FROM events WHERE user_id BETWEEN 0 AND 50 AND value > 20")
def having_without_agg(spark, sf_dir):
    return EVENTS.between(0, 50).having("value > 20").select("event_id").to_df(_read(spark, sf_dir, "events"))


@_query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def custom_agg(spark, sf_dir):
    return EVENTS.agg("event_type", Custom("user_id", "users", F.count_distinct("user_id"))).to_df(_read(spark, sf_dir, "events"))


# predicates, mappers, hints


@_query("SELECT event_id, value FROM events WHERE user_id BETWEEN 3 AND 90 AND event_type = 'click'")
def predicate_column(spark, sf_dir):
    return EVENTS.between(3, 90).where(F.col("event_type") == "click").select("event_id", "value").to_df(_read(spark, sf_dir, "events"))


@_query("SELECT event_id, value FROM events WHERE user_id BETWEEN 3 AND 90 AND event_type = 'click' AND value > 10")
def predicate_udf(spark, sf_dir):
    return EVENTS.between(3, 90).where(lambda r: r["event_type"] == "click").where("value > 10").select("event_id", "value").to_df(_read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value"))


@_query("SELECT event_id FROM events WHERE value >= 50 AND user_id <= 70")
def predicate_dsl(spark, sf_dir):
    return EVENTS.where(compare("value", ">=", 50)).where(compare("user_id", "<=", 70)).select("event_id").to_df(_read(spark, sf_dir, "events"))


@_query("SELECT event_id, user_id FROM events WHERE user_id BETWEEN 0 AND 49 AND event_type = 'view'")
def equality_hint(spark, sf_dir):
    return _events_read(spark, sf_dir).range_query(0, 49, hint=("event_type", "view")).select("event_id", "user_id")


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = 10.0")
def hint_double(spark, sf_dir):
    def make(folder: str) -> Table:
        df = _read(spark, sf_dir, "lineitem")
        made = Table.create(spark, folder, TemporalSchema.of(df, "l_orderkey", "l_shipdate"), bloom_columns=("l_quantity",))
        made.append(df)
        return made

    return _kept(spark, sf_dir, "lines", make).range_query(hint=("l_quantity", 10.0)).select("l_orderkey", "l_linenumber")


@_query("SELECT event_type, count(*) AS n, min(value * 2) AS lo, max(value * 2) AS hi FROM events GROUP BY event_type")
def mapper_derived(spark, sf_dir):
    df = _read(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")
    schema = TemporalSchema.of(df.withColumn("twice", F.col("value") * 2).drop("value"), "user_id", "ts")
    made = Table.create(spark, _folder(spark), schema, mapper=lambda d: d.withColumn("twice", F.col("value") * 2))
    made.append(df)
    return made.range_query(group_by="event_type", aggs=[Count(alias="n"), Min("twice", "lo"), Max("twice", "hi")])


# order and pages


@_query("SELECT event_id, user_id FROM events WHERE user_id < 20 ORDER BY user_id, event_id")
def sort_asc(spark, sf_dir):
    return EVENTS.where("user_id < 20").select("event_id", "user_id").sort("user_id", "event_id").to_df(_read(spark, sf_dir, "events"))


@_query("SELECT event_type, value, event_id FROM events WHERE user_id < 20 ORDER BY event_type, value DESC, event_id DESC")
def sort_multi_desc(spark, sf_dir):
    return EVENTS.where("user_id < 20").select("event_type", "value", "event_id").sort("event_type", "-value", "-event_id").to_df(_read(spark, sf_dir, "events"))


@_query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25")
def top_k(spark, sf_dir):
    return EVENTS.select("event_id", "value").sort("-value", "event_id").to_df(_read(spark, sf_dir, "events")).limit(25)


@_query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 10 OFFSET 20")
def paged_result(spark, sf_dir):
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return page(_read(spark, sf_dir, "lineitem").select(*names), 3, 10, names)


# grid and shapes

_GEO = "SELECT *, 111 + CAST((event_id * 7919) % 40000 AS DOUBLE) / 10000 AS lon, 21 + CAST((event_id * 104729) % 50000 AS DOUBLE) / 10000 AS lat FROM events"
_BITS = " + ".join(f"(((CAST(least(greatest(floor((lon - 111.0::DOUBLE) / 4.0::DOUBLE * 128), 0), 127) AS BIGINT) >> {k}) & 1) << {2 * k}) + (((CAST(least(greatest(floor((lat - 21.0::DOUBLE) / 5.0::DOUBLE * 128), 0), 127) AS BIGINT) >> {k}) & 1) << {2 * k + 1})" for k in range(7))
_ZGEO = f"SELECT *, {_BITS} AS zcode FROM ({_GEO})"
_POLYGON = Polygon(((111.5, 21.5), (114.5, 22.0), (114.0, 25.5), (112.5, 23.0), (111.2, 25.0)))
_RECT, _CIRCLE = Rectangle(112.0, 22.0, 113.0, 23.5), Circle(113.0, 23.0, 0.75)


def _geo(spark, sf_dir) -> DataFrame:
    lon = F.lit(111) + ((F.col("event_id") * 7919) % 40000).cast("double") / 10000
    lat = F.lit(21) + ((F.col("event_id") * 104729) % 50000).cast("double") / 10000
    df = _read(spark, sf_dir, "events").withColumns({"lon": lon, "lat": lat})
    return df.withColumn("zcode", GRID.zcode("lon", "lat"))


def _geo_table(spark, sf_dir) -> Table:
    def make(folder: str) -> Table:
        df = _geo(spark, sf_dir).select("event_id", "event_type", "value", "zcode", "ts", "lon", "lat")
        made = Table.create(spark, folder, TemporalSchema.of(df, "zcode", "ts"), grid=GRID)
        made.append(df)
        return made

    return _kept(spark, sf_dir, "geo", make)


def _in_shape(spark, sf_dir, shape, **how) -> DataFrame:
    return _geo_table(spark, sf_dir).geo_query(shape, x="lon", y="lat", **how)


def _crossing(a, b) -> str:
    """The SQL of one edge: 1 if a ray to the right crosses it."""
    (x1, y1), (x2, y2) = sorted((a, b), key=lambda p: p[1])
    return "0" if y1 == y2 else f"CASE WHEN lat >= {y1}::DOUBLE AND lat < {y2}::DOUBLE AND lon < {x1}::DOUBLE + (lat - {y1}::DOUBLE) * ({(x2 - x1) / (y2 - y1)!r}::DOUBLE) THEN 1 ELSE 0 END"


_INSIDE = "(" + " + ".join(_crossing(a, b) for a, b in zip(_POLYGON.points, [*_POLYGON.points[1:], _POLYGON.points[0]])) + ") % 2 = 1"


@_query(f"SELECT event_id, zcode FROM ({_ZGEO})")
def zcode(spark, sf_dir):
    return _geo(spark, sf_dir).select("event_id", "zcode")


@_query(f"SELECT zcode, count(*) AS n FROM ({_ZGEO}) GROUP BY zcode")
def cell_histogram(spark, sf_dir):
    return RangeQuery("zcode", "ts").agg("zcode", Count(alias="n")).to_df(_geo(spark, sf_dir))


@_query(f"SELECT event_id FROM ({_GEO}) WHERE lon BETWEEN 112.0::DOUBLE AND 113.0::DOUBLE AND lat BETWEEN 22.0::DOUBLE AND 23.5::DOUBLE")
def geo_rectangle(spark, sf_dir):
    return _in_shape(spark, sf_dir, _RECT).select("event_id")


@_query(f"SELECT event_id FROM ({_GEO}) WHERE least(greatest(floor((lon - 111.0::DOUBLE) / 4.0::DOUBLE * 128), 0), 127) BETWEEN 32 AND 64 AND least(greatest(floor((lat - 21.0::DOUBLE) / 5.0::DOUBLE * 128), 0), 127) BETWEEN 25 AND 64")
def geo_rectangle_cells(spark, sf_dir):
    return _in_shape(spark, sf_dir, _RECT, exact=False).select("event_id")


@_query(f"SELECT event_id FROM ({_GEO}) WHERE sqrt((lon - 113.0::DOUBLE) * (lon - 113.0::DOUBLE) + (lat - 23.0::DOUBLE) * (lat - 23.0::DOUBLE)) <= 0.75::DOUBLE")
def geo_circle(spark, sf_dir):
    return _in_shape(spark, sf_dir, _CIRCLE).select("event_id")


@_query(f"SELECT event_id FROM ({_GEO}) WHERE {_INSIDE}")
def geo_polygon(spark, sf_dir):
    return _in_shape(spark, sf_dir, _POLYGON).select("event_id")


@_query(f"SELECT event_type, count(*) AS n, max(value) AS hi FROM ({_GEO}) WHERE lon BETWEEN 112.0::DOUBLE AND 113.0::DOUBLE AND lat BETWEEN 22.0::DOUBLE AND 23.5::DOUBLE AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' GROUP BY event_type")
def geo_agg(spark, sf_dir):
    return _in_shape(spark, sf_dir, _RECT, start=_ntz("2024-01-05"), end=_ntz("2024-01-20"), group_by="event_type", aggs=[Count(alias="n"), Max("value", "hi")])


_TENTHS = "SELECT *, CAST(event_id % 11 AS DOUBLE) / 10 AS lon, CAST(event_id // 11 % 11 AS DOUBLE) / 10 AS lat FROM events"


@_query(f"SELECT event_id FROM ({_TENTHS}) WHERE lon BETWEEN 0.0::DOUBLE AND 0.3::DOUBLE AND lat BETWEEN 0.2::DOUBLE AND 0.7::DOUBLE")
def geo_borders(spark, sf_dir):
    """Points on the borders of cells, and a rectangle whose edges are borders."""

    def make(folder: str) -> Table:
        grid, df = Grid(0.0, 1.0, 0.0, 1.0, 10), _read(spark, sf_dir, "events")
        df = df.select("event_id", "ts", ((F.col("event_id") % 11).cast("double") / 10).alias("lon"), (F.floor(F.col("event_id") / 11) % 11).cast("double").alias("lat")).withColumn("lat", F.col("lat") / 10)
        df = df.withColumn("zcode", grid.zcode("lon", "lat"))
        made = Table.create(spark, folder, TemporalSchema.of(df, "zcode", "ts"), grid=grid)
        made.append(df)
        return made

    return _kept(spark, sf_dir, "borders", make).geo_query(Rectangle(0.0, 0.2, 0.3, 0.7), x="lon", y="lat").select("event_id")


_NET = "SELECT *, CAST((user_id * 2654435761) % 4294967296 - 2147483648 AS BIGINT) AS dest_ip FROM events"


@_query(f"SELECT event_id, dest_ip FROM ({_NET}) WHERE dest_ip BETWEEN -1062731776 AND 1000000000")
def network_range(spark, sf_dir):
    return _net_table(spark, sf_dir).network_query("192.168.0.0", 1_000_000_000).select("event_id", "dest_ip")


def _net_table(spark, sf_dir) -> Table:
    def make(folder: str) -> Table:
        df = _read(spark, sf_dir, "events").withColumn("dest_ip", ((F.col("user_id") * F.lit(2654435761)) % F.lit(4294967296) - F.lit(2147483648)).cast("int"))
        made = Table.create(spark, folder, TemporalSchema.of(df, "dest_ip", "ts"))
        made.append(df)
        return made

    return _kept(spark, sf_dir, "net", make)


_BLOCKS = tuple((-2_100_000_000 + 400_000_000 * k, -2_100_000_000 + 400_000_000 * k + 200_000_000) for k in range(11))


@_query(f"SELECT event_id FROM ({_NET}) WHERE " + " OR ".join(f"dest_ip BETWEEN {a} AND {b}" for a, b in _BLOCKS))
def network_many_ranges(spark, sf_dir):
    table = _net_table(spark, sf_dir)
    return table.run(table.query().ranges_of(_BLOCKS)).select("event_id")


# partitioning

_IVAL = "CAST(least(greatest(floor(user_id / 9.375::DOUBLE), 0), 15) AS BIGINT)"


@_query(f"SELECT i.k AS interval, count(e.event_id) AS n FROM (SELECT unnest(range(16)) AS k) i LEFT JOIN events e ON {_IVAL} = i.k GROUP BY i.k")
def interval_histogram(spark, sf_dir):
    return partitioning.histogram(_read(spark, sf_dir, "events"), "user_id", 0, 150, 16)


@_query(f"SELECT round(max(n) / avg(n) - 1, 6) AS skew FROM (SELECT i.k, count(e.event_id) AS n FROM (SELECT unnest(range(16)) AS k) i LEFT JOIN events e ON {_IVAL} = i.k GROUP BY i.k)")
def skew_factor(spark, sf_dir):
    return partitioning.histogram(_read(spark, sf_dir, "events"), "user_id", 0, 150, 16).agg(F.round(partitioning.skew_column("n"), 6).alias("skew"))


@_query(f"SELECT i.k // 4 AS partition, CAST(sum(n) AS BIGINT) AS load FROM (SELECT k, count(e.event_id) AS n FROM (SELECT unnest(range(16)) AS k) i LEFT JOIN events e ON {_IVAL} = k GROUP BY k) i GROUP BY 1")
def partition_loads(spark, sf_dir):
    return partitioning.loads(partitioning.histogram(_read(spark, sf_dir, "events"), "user_id", 0, 150, 16), partitioning.equal_plan(4, 16))


@_query(f"""
WITH RECURSIVE h AS (SELECT i.k, count(e.event_id) AS n FROM (SELECT unnest(range(16)) AS k) i LEFT JOIN events e ON {_IVAL} = i.k GROUP BY i.k),
goal AS (SELECT sum(n) / 4.0 AS g FROM h),
r AS (
  SELECT CAST(-1 AS BIGINT) AS k, CAST(0 AS BIGINT) AS part, CAST(0 AS BIGINT) AS at, CAST(0 AS BIGINT) AS fill
  UNION ALL
  SELECT h.k, r.at, CASE WHEN r.at < 3 AND r.fill + h.n >= g THEN r.at + 1 ELSE r.at END, CASE WHEN r.at < 3 AND r.fill + h.n >= g THEN 0 ELSE r.fill + h.n END
  FROM r JOIN h ON h.k = r.k + 1, goal
)
SELECT part AS partition, CAST(sum(n) AS BIGINT) AS load FROM r JOIN h USING (k) GROUP BY part
""")
def repartition_plan(spark, sf_dir):
    hist = partitioning.histogram(_read(spark, sf_dir, "events"), "user_id", 0, 150, 16)
    plan = partitioning.repartition_plan(partitioning.weights(hist, 16), 4)
    return partitioning.loads(hist, plan)


# chunk store


def _thirds(spark, sf_dir) -> list[DataFrame]:
    df, first, second = _read(spark, sf_dir, "events"), _ntz("2024-01-11"), _ntz("2024-01-21")
    return [df.where(F.col("ts") < first), df.where((F.col("ts") >= first) & (F.col("ts") < second)), df.where(F.col("ts") >= second)]


def _events_table(spark, sf_dir, folder: str | None = None, hot: bool = False, **how) -> Table:
    """All events in three appends by time, the last of them to the hot tier if asked."""
    parts = _thirds(spark, sf_dir)
    made = Table.create(spark, folder or _folder(spark), TemporalSchema.of(parts[0], "user_id", "ts"), bloom_columns=("event_type",), **how)
    for k, part in enumerate(parts):
        made.append(part, hot=hot and k == 2)
    return made


def _events_read(spark, sf_dir) -> Table:
    return _kept(spark, sf_dir, "events", lambda folder: _events_table(spark, sf_dir, folder))


@_query("SELECT user_id, count(*) AS n FROM events WHERE user_id BETWEEN 20 AND 40 AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-29' GROUP BY user_id")
def stored_range_query(spark, sf_dir):
    return _events_read(spark, sf_dir).range_query(20, 40, _ntz("2024-01-03"), _ntz("2024-01-29"), group_by="user_id", aggs=[Count(alias="n")])


@_query("SELECT event_id, user_id, ts, value FROM events WHERE user_id BETWEEN 10 AND 12")
def stored_append(spark, sf_dir):
    return _events_table(spark, sf_dir).range_query(10, 12).select("event_id", "user_id", "ts", "value")


@_query("SELECT event_id, user_id, value FROM events")
def hot_cold_union(spark, sf_dir):
    return _events_table(spark, sf_dir, hot=True).to_df().select("event_id", "user_id", "value")


@_query("SELECT CAST(count(*) AS BIGINT) AS rows, CAST(min(user_id) AS DOUBLE) AS key_lo, CAST(max(user_id) AS DOUBLE) AS key_hi, epoch_us(min(ts)) AS ts_lo, epoch_us(max(ts)) AS ts_hi FROM events")
def chunk_boxes(spark, sf_dir):
    return _events_read(spark, sf_dir).manifest.boxes().agg(F.sum("rows").alias("rows"), F.min("key_lo").alias("key_lo"), F.max("key_hi").alias("key_hi"), F.min("ts_lo").alias("ts_lo"), F.max("ts_hi").alias("ts_hi"))


@_query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-11'")
def retention_survivors(spark, sf_dir):
    made = _events_table(spark, sf_dir)
    made.retain(1_704_931_200_000_000)
    return made.to_df().select("event_id")


@_query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY event_type")
def compacted(spark, sf_dir):
    made = _events_table(spark, sf_dir)
    made.compact()
    return made.range_query(group_by="event_type", aggs=[Count(alias="n"), Sum("value", "s")]).withColumn("s", F.round("s", 4))


@_query(f"SELECT event_id FROM ({_GEO}) WHERE lon BETWEEN 112.0::DOUBLE AND 113.0::DOUBLE AND lat BETWEEN 22.0::DOUBLE AND 23.5::DOUBLE AND ts >= TIMESTAMP '2024-01-10'")
def stored_geo_query(spark, sf_dir):
    return _in_shape(spark, sf_dir, _RECT, start=_ntz("2024-01-10")).select("event_id")


# records and scalar functions


@_query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_valid(spark, sf_dir):
    df = _read(spark, sf_dir, "events").select(F.concat(F.lit('{"event_id": '), F.col("event_id"), F.lit(", "), F.expr("substring(props, 2)")).alias("value"))
    return records.parse(df, T.StructType().add("event_id", "long").add("k", "integer"), required=("k",)).rows


@_query("SELECT event_id, 'missing or malformed value' AS reason FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 'unknown attribute' FROM events WHERE event_id % 3 = 1")
def json_rejected(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, F.format_string('{"event_id": %d, "k": "x"}', "event_id")).when(F.col("event_id") % 3 == 1, F.format_string('{"event_id": %d, "other": 1}', "event_id")).otherwise(F.format_string('{"event_id": %d}', "event_id"))
    found = records.parse(_read(spark, sf_dir, "events").select(text.alias("value")), T.StructType().add("event_id", "long").add("k", "integer")).rejected
    return found.select(F.get_json_object("record", "$.event_id").cast("long").alias("event_id"), "reason")


@_query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text, (epoch_us(ts) // 1000000) * 1000 AS millis FROM events")
def datetime_format(spark, sf_dir):
    df = _read(spark, sf_dir, "events").select("event_id", scalar.format_millis(F.unix_millis(F.col("ts").cast("timestamp"))).alias("text"))
    return df.withColumn("millis", scalar.parse_millis("text"))


@_query("""SELECT event_id, '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS value FROM events""")
def tuple_to_json(spark, sf_dir):
    df = _read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    made = records.to_json(df, TemporalSchema(df.schema, "user_id"))
    return made.select(F.get_json_object("value", "$.event_id").cast("long").alias("event_id"), "value")


@_query("SELECT event_id, CAST((event_id % 256) * 16777216 + (event_id // 7 % 256) * 65536 + 258 - CASE WHEN event_id % 256 >= 128 THEN 4294967296 ELSE 0 END AS INTEGER) AS ip FROM events")
def ipv4_numbers(spark, sf_dir):
    text = F.concat_ws(".", (F.col("event_id") % 256).cast("string"), (F.floor(F.col("event_id") / 7) % 256).cast("string"), F.lit("1"), F.lit("2"))
    return _read(spark, sf_dir, "events").select("event_id", scalar.ipv4_to_int(text).alias("ip"))


@_query("SELECT event_id, translate(replace(event_type, 'i', ''), '', '') AS t, TRY_CAST(event_type AS BIGINT) AS n FROM events")
def text_functions(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", scalar.delete_chars(scalar.strip_special(F.concat(F.lit(" #"), "event_type", F.lit("!?"))), "i").alias("t"), scalar.typed("event_type", "long").alias("n"))


# services


@_query("SELECT event_id, ts, value FROM events WHERE user_id = 42 AND event_type = 'click' AND ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-25' ORDER BY ts")
def track_search(spark, sf_dir):
    return services.track(_events_read(spark, sf_dir), _ntz("2024-01-02"), _ntz("2024-01-25"), user_id=42, event_type="click").select("event_id", "ts", "value")


@_query("SELECT event_id, value FROM events WHERE user_id = 7 ORDER BY ts, event_id LIMIT 20 OFFSET 20")
def track_second_page(spark, sf_dir):
    track = services.track(_events_read(spark, sf_dir), None, None, user_id=7)
    return page(track, 2, 20, ["ts", "event_id"]).select("event_id", "value")


def _devices(spark, sf_dir) -> Table:
    def make(folder: str) -> Table:
        df = _geo(spark, sf_dir).select("event_id", "user_id", "zcode", "lon", "lat", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
        made = Table.create(spark, folder, TemporalSchema.of(df, "zcode", "at"), grid=GRID)
        made.append(df)
        return made

    return _kept(spark, sf_dir, "devices", make)


_NOW = 1_705_276_800_000  # 2024-01-15


@_query("SELECT event_id, user_id FROM events WHERE epoch_us(ts) // 1000 BETWEEN 1705276800000 - 43200000 AND 1705276800000")
def positions_now(spark, sf_dir):
    return services.current_positions(_devices(spark, sf_dir), 43_200, _NOW).select("event_id", "user_id")


@_query(f"SELECT 'true' AS success, CAST(count(*) AS BIGINT) AS n FROM ({_GEO}) WHERE lon BETWEEN 112.0::DOUBLE AND 113.0::DOUBLE AND lat BETWEEN 22.0::DOUBLE AND 23.5::DOUBLE AND epoch_us(ts) // 1000 BETWEEN 1705276800000 - 864000000 AND 1705276800000")
def positions_in_shape(spark, sf_dir):
    answer = services.count_in_shape(_devices(spark, sf_dir), {"type": "rectangle", "leftTop": "112.0,23.5", "rightBottom": "113.0,22.0"}, seconds=864_000, now_millis=_NOW, x="lon", y="lat")
    text = spark.createDataFrame([(answer,)], "answer string")
    return text.select(F.get_json_object("answer", "$.success").alias("success"), F.get_json_object("answer", "$.result").cast("long").alias("n"))


@_query("SELECT user_id, count(*) AS n FROM events WHERE epoch_us(ts) // 1000 BETWEEN (SELECT epoch_us(max(ts)) // 1000 - 86400000 FROM events) AND (SELECT epoch_us(max(ts)) // 1000 FROM events) GROUP BY user_id")
def recent_window(spark, sf_dir):
    df = _read(spark, sf_dir, "events").withColumn("millis", F.unix_millis(F.col("ts").cast("timestamp")))
    return RangeQuery("user_id", "millis").during(*scalar.recent_bounds(86_400, df.agg(F.max("millis")).first()[0])).agg("user_id", Count(alias="n")).to_df(df)


# streams


@_query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY event_type")
def stream_replay(spark, sf_dir):
    folder, df = _folder(spark), _read(spark, sf_dir, "events")
    made = Table.create(spark, folder, TemporalSchema.of(df, "user_id", "ts"))
    stream = spark.readStream.schema(df.schema).parquet(f"{sf_dir}/events.parquet*")
    start_ingest(made, stream, f"{folder}/_checkpoint").awaitTermination()
    return made.range_query(group_by="event_type", aggs=[Count(alias="n"), Sum("value", "s")]).withColumn("s", F.round("s", 4))


@_query("SELECT event_id, user_id, epoch_us(ts) // 1000000 * 1000 AS millis FROM events WHERE event_id % 10 <> 0")
def stream_records(spark, sf_dir):
    folder = _folder(spark)
    time = F.when(F.col("event_id") % 10 != 0, F.date_format("ts", scalar.PATTERN)).otherwise("no time")
    _read(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", "user_id", time.alias("millis"))).alias("value")).write.text(f"{folder}/lines")
    schema = TemporalSchema().add_long("event_id").add_long("user_id").add_long("millis").set_index_field("user_id").set_temporal_field("millis")
    made = Table.create(spark, f"{folder}/table", schema)
    start_records(made, spark.readStream.text(f"{folder}/lines"), schema, f"{folder}/_checkpoint", f"{folder}/rejected", datetime_field="millis").awaitTermination()
    return made.to_df()


# generators


@_query("SELECT k % 7 AS key, count(*) AS n FROM (SELECT unnest(range(10000)) AS k) GROUP BY 1")
def round_robin_keys(spark, sf_dir):
    return generators.round_robin_keys(spark, 10_000, 7).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@_query()
def zipf_keys(spark, sf_dir):
    return generators.zipf_keys(spark, 10_000, 100).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@_query()
def moving_cars(spark, sf_dir):
    return generators.moving_cars(spark, 20, 100, GRID)
