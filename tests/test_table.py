import json
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronozone import services
from chronozone.cli import main, part
from chronozone.config import Config
from chronozone.functions.geo import Grid, Rectangle
from chronozone.functions.scalar import ipv4_to_int, ipv4_value, parse_millis, typed
from chronozone.operators.aggregates import Count, Max
from chronozone.plans import manifest
from chronozone.plans.files import Store
from chronozone.plans.manifest import Conflict
from chronozone.plans.table import Catalog, Table
from chronozone.schema import TemporalSchema
from chronozone.sources import generators, readers
from chronozone.sources.records import parse, to_json
from chronozone.streaming.client import BatchWriter
from chronozone.streaming.ingest import rate_limited, start_ingest, start_records, windowed_counts
from chronozone.streaming.status import Progress, Timings, system_state


def schema():
    return TemporalSchema().add_int("id").add_long("ts").add_double("v").add_varchar("s", 10).set_index_field("id").set_temporal_field("ts")


def rows(spark, n, start=0):
    return spark.range(start, start + n).select((F.col("id") % 100).cast("int").alias("id"), F.col("id").alias("ts"), F.col("id").cast("double").alias("v"), F.concat(F.lit("p"), F.col("id") % 100).alias("s"))


def test_schema():
    s = schema()
    assert s.field_index("v") == 2 and s.field_index("x") == -1
    assert s.value("v", (1, 2, 3.0, "a")) == 3.0 and s.value("x", (1,)) is None
    assert s.tuple_length() == s.tuple_length() == 4 + 8 + 8 + 10
    assert TemporalSchema.from_json(s.to_json()) == s == s.duplicate() and "id int (index)" in str(s)
    assert s != schema().add_int("more")
    with pytest.raises(ValueError):
        TemporalSchema().add_int("a").check()
    with pytest.raises(ValueError):
        schema().set_index_field("s")


def test_append_query_prune(spark, tmp_path):
    path = (tmp_path / "t").as_uri()
    made = Table.create(spark, path, schema(), bloom_columns=["s"], config=Config(partitions=4))
    assert made.to_df().count() == 0
    made.append(rows(spark, 1000))
    made.append(rows(spark, 1000, 1000))
    again = Table.open(spark, path)
    assert again.schema == schema() and again.to_df().count() == 2000
    assert again.range_query(0, 49).count() == 1000 and again.range_query(0, 0, hint=("s", "p0")).count() == 20
    assert len(made.manifest.prune(0, 10, 0, 500)) < len(made.manifest.prune())
    assert made.manifest.prune(200) == [] and made.manifest.prune(most=1) is None
    assert [r.n for r in again.range_query(None, None, 0, 499, group_by="id", aggs=[Count(alias="n"), Max("v", "hi")], having="hi < 450", order_by=["id"]).collect()] == [5] * 50
    with pytest.raises(ValueError):
        Table.create(spark, path, schema())


def test_hot_rows_compaction_retention(spark, tmp_path):
    made = Table.create(spark, (tmp_path / "t").as_uri(), schema())
    made.append(rows(spark, 100))
    made.append(rows(spark, 100, 100), hot=True)
    assert made.to_df().count() == 200 and Table.open(spark, made.path).to_df().count() == 100
    made.flush()
    assert made.to_df().count() == 200 and Table.open(spark, made.path).to_df().count() == 200
    old = made.manifest.version()
    assert made.retain(100) > 0
    assert made.to_df().agg(F.min("ts")).first()[0] == 100
    made.compact()
    assert made.to_df().count() == 100
    assert made.scan(version=old).count() == 200


def test_nulls_are_never_pruned(spark, tmp_path):
    made = Table.create(spark, (tmp_path / "t").as_uri(), schema())
    made.append(spark.createDataFrame([(None, None, None, None), (5, 5, 5.0, "")], "id int, ts long, v double, s string"))
    assert made.to_df().count() == 2 and made.range_query(5, 5, 5, 5).count() == 1


def test_many_files_are_read_without_a_list(spark, tmp_path):
    made = Table.create(spark, (tmp_path / "t").as_uri(), schema(), config=Config(partitions=6, listed_files=2))
    made.append(rows(spark, 600))
    made.append(rows(spark, 600, 600))
    assert made.to_df().count() == 1200 and made.range_query(3, 3).count() == 12


def test_catalog(spark, tmp_path):
    own = Catalog(spark, tmp_path.as_uri(), schema())
    assert own.get_schema() == schema() and own.get_schema("x") is None
    assert own.create_schema("x", schema()) and not own.create_schema("x", schema()) and not own.create_schema("y", None)
    assert own.names() == ["default", "x"]


def test_stream_is_exactly_once(spark, tmp_path):
    made, source = Table.create(spark, (tmp_path / "t").as_uri(), schema()), str(tmp_path / "in")
    rows(spark, 100).write.parquet(source)
    stream = lambda: spark.readStream.schema(schema().struct).option("maxFilesPerTrigger", 1).parquet(source)
    start_ingest(made, stream(), str(tmp_path / "c")).awaitTermination()
    assert made.to_df().count() == 100
    rows(spark, 50, 100).write.mode("append").parquet(source)
    start_ingest(made, stream(), str(tmp_path / "c")).awaitTermination()
    assert made.to_df().count() == 150
    made.append_batch(rows(spark, 7), "ingest", 0)
    assert made.to_df().count() == 150


def test_records(spark, tmp_path):
    s = T.StructType().add("k", "integer").add("t", "long").add("x", "double")
    texts = ['{"k": 1, "t": "2024-01-02 03:04:05", "x": 1.5}', '{"k": 1}', '{"k": "a", "t": "2024-01-02 03:04:05"}', '{"k": 1, "t": "2024-01-02 03:04:05", "y": 1}', "nonsense", None, '{"t": "2024-01-02 03:04:05"}', '{"k": 1, "t": "bad"}', ""]
    found = parse(spark.createDataFrame([(t,) for t in texts], "value string"), s, datetime_field="t")
    assert sorted(map(str, ((r.k, r.t, r.x) for r in found.rows.collect()))) == ["(1, 1704164645000, 1.5)", "(None, 1704164645000, None)"]
    assert found.rejected.count() == 7
    own = TemporalSchema(s, "k", "t")
    assert [json.loads(r.value) for r in to_json(found.rows.where("k = 1"), own, readable=True).collect()] == [{"k": 1, "t": "2024-01-02 03:04:05", "x": 1.5}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(t for t in texts if t))
    made = Table.create(spark, (tmp_path / "t").as_uri(), own)
    start_records(made, readers.lines(spark, str(tmp_path / "in"), streaming=True), own, str(tmp_path / "c"), str(tmp_path / "bad"), datetime_field="t").awaitTermination()
    assert made.to_df().count() == 2 and spark.read.parquet(str(tmp_path / "bad")).count() == 5


def test_geo_and_network_and_services(spark, tmp_path):
    grid = Grid(0, 100, 0, 100, 128)
    raw = spark.range(10_000).select((F.col("id") % 100).cast("int").alias("devid"), (F.col("id") % 100).cast("double").alias("longitude"), F.floor(F.col("id") / 100).cast("double").alias("latitude"), F.col("id").alias("ts"))
    own = TemporalSchema().add_int("devid").add_double("longitude").add_double("latitude").add_long("ts").add_long("zcode").set_index_field("zcode").set_temporal_field("ts")
    made = Table.create(spark, (tmp_path / "g").as_uri(), own, mapper=lambda d: d.withColumn("zcode", grid.zcode("longitude", "latitude")), grid=grid)
    made.append(raw)
    assert made.geo_query(Rectangle(10, 10, 19.9, 19.9)).count() == 100
    assert made.geo_query(Rectangle(10, 10, 19.9, 19.9), exact=False).count() >= 100
    box = {"type": "rectangle", "leftTop": "10,19.9", "rightBottom": "19.9,10"}
    assert json.loads(services.count_in_shape(made, box, now_millis=10_000))["result"] == 100
    assert json.loads(services.count_in_shape(made, box, device=12, now_millis=10_000))["result"] == 10
    assert json.loads(services.count_in_shape(made, {"type": "circle"}))["errorCode"] == "1002"
    assert services.track(made, 0, 5_000, devid=3).count() == 50
    answer = json.loads(services.track_page(made, 0, 10_000, 2, 30, ["ts"], devid=3))
    assert (len(answer["result"]), answer["total"], answer["totalPage"]) == (30, 100, 4)
    assert len(json.loads(services.positions_json(made, seconds=1, now_millis=9_999))["result"]) == 1001
    net = Table.create(spark, (tmp_path / "n").as_uri(), TemporalSchema().add_int("destIP").add_long("ts").set_index_field("destIP").set_temporal_field("ts"))
    net.append(spark.createDataFrame([("10.0.0.1",), ("192.168.1.1",), ("x",), ("1.2.3.400",)], "a string").select(ipv4_to_int("a").alias("destIP"), F.lit(1).cast("long").alias("ts")))
    assert net.network_query("10.0.0.0", "10.255.255.255").count() == 1 and net.to_df().where("destIP is null").count() == 2
    assert ipv4_value("255.255.255.255") == -1


def test_sources_and_generators(spark, tmp_path):
    (tmp_path / "t.csv").write_text("1,2008-02-02 15:36:08,116.5,39.9\n2,2008-02-02 15:36:08,99.0,39.9\nbad\n")
    assert [(r.id, r.timestamp) for r in readers.traces(spark, str(tmp_path / "t.csv")).collect()] == [(1, 1201966568000)]
    (tmp_path / "n.txt").write_text("1.2.3.4 10.0.0.1 u\n5 6 v\n")
    assert sorted(r.destIP for r in readers.network_log(spark, str(tmp_path / "n.txt")).collect()) == [6, 167772161]
    assert generators.uniform_keys(spark, 500, 10).agg(F.countDistinct("key")).first()[0] == 10
    counts = [r.n for r in generators.zipf_keys(spark, 2000, 50, shuffled=False).groupBy("key").agg(F.count(F.lit(1)).alias("n")).orderBy("key").collect()]
    assert counts[0] == max(counts) > 5 * counts[-1]
    assert generators.normal_keys(spark, 1000).where("abs(key - 500000) > 15000").count() == 0
    grid = Grid(0, 1, 0, 1, 16)
    assert generators.uniform_points(spark, 100, grid).where("longitude < 0 or longitude > 1 or zcode >= 256").count() == 0
    cars = generators.moving_cars(spark, 3, 200, grid, speed=0.05)
    assert cars.count() == 600 and cars.where("longitude < 0 or longitude > 1 or latitude < 0 or latitude > 1").count() == 0
    df = spark.createDataFrame([("12", "2024-01-02 00:00:00"), ("x", "y")], "a string, b string")
    assert [tuple(r) for r in df.select(typed("a", "int"), parse_millis("b")).collect()] == [(12, 1704153600000), (None, None)]


def test_config_metrics_cli(spark, tmp_path, capsys):
    (tmp_path / "c.yaml").write_text("# settings\nchunk_rows: 1000\ncodec: 'snappy'\nload-balance: false\n")
    made = Config.from_file(tmp_path / "c.yaml")
    assert (made.chunk_rows, made.codec, made.load_balance) == (1000, "snappy", False)
    with pytest.raises(ValueError):
        Config().override({"nothing": 1})
    state = system_state(spark, Progress(), made).first()
    assert state.settings["codec"] == "snappy" and state.history == []
    timings = Timings()
    with timings.phase("scan", "a"):
        pass
    assert list(timings.means()) == [("a", "scan")] and timings.total("scan") >= 0
    rows(spark, 100).write.parquet(str(tmp_path / "in"))
    table = (tmp_path / "t").as_uri()
    assert main(["create", "--table", table, "--input", str(tmp_path / "in"), "--index", "id", "--time", "ts"]) == 0
    assert main(["query", "--table", table, "--low", "0", "--high", "9", "--agg", "count"]) == 0
    assert "|10      |" in capsys.readouterr().out
    assert main(["retain", "--table", table, "--before", "10"]) == 0 and main(["state", "--table", table]) == 0


def test_rewrites_of_one_version_leave_each_row_once(spark, tmp_path):
    made = Table.create(spark, (tmp_path / "t").as_uri(), schema())
    made.append(rows(spark, 100))
    before = made.manifest.version()
    first = made._write(made.to_df(), "one")
    made.manifest.replace(first, "one", before.segments)
    with pytest.raises(Conflict):
        made.manifest.replace(made._write(made.to_df(), "two"), "two", before.segments)
    assert made.to_df().count() == 100
    # a compaction that meets a finished retention begins again
    made.append(rows(spark, 100, 100))
    versions, meddled = Table.open(spark, made.path), []
    old = made.manifest.version

    def version(number=None):
        found = old(number)
        if not meddled:
            meddled.append(versions.retain(100))
        return found

    made.manifest.version = version
    made.compact()
    assert meddled == [1] and made.to_df().agg(F.min("ts"), F.count("*")).first()[:] == (100, 100)


def test_publishing_is_exclusive(spark, tmp_path):
    store = Store(spark, tmp_path.as_uri())
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: store.write("v/1.json", f"writer {k}"), range(8)))
    assert sum(won) == 1 and store.read("v/1.json") == f"writer {won.index(True)}"
    assert store.names("v") == ["1.json"]  # nothing temporary stays


def test_compaction_of_small_segments(spark, tmp_path):
    made = Table.create(spark, (tmp_path / "t").as_uri(), schema(), config=Config(partitions=2))
    made.append(rows(spark, 1000))
    for k in range(3):
        made.append(rows(spark, 10, 1000 + 10 * k))
    large = made.manifest.version().segments[0]
    made.compact(small_rows=100)
    assert len(made.manifest.version().segments) == 2 and large in made.manifest.version().segments
    made.compact(small_rows=20)
    assert len(made.manifest.version().segments) == 2 and made.to_df().count() == 1030
    assert made.manifest.sizes(made.manifest.version()) == {large: 1000, made.manifest.version().segments[0]: 30}


def test_retention_by_settings(spark, tmp_path):
    made = Table.create(spark, (tmp_path / "t").as_uri(), schema(), config=Config(keep_hours=1, remove_interval_hours=5))
    hour = 3_600_000
    made.append(spark.createDataFrame([(1, 0, 0.0, "a")], schema().struct))
    made.append(spark.createDataFrame([(1, 2 * hour, 0.0, "b"), (2, 3 * hour, 0.0, "c")], schema().struct))
    assert made.retain_due() == 1 and [r.s for r in made.to_df().orderBy("ts").collect()] == ["b", "c"]
    made.append(spark.createDataFrame([(1, 9 * hour, 0.0, "d")], schema().struct))
    assert made.retain_due() == 0 and made.retain(delete_files=True) == 1
    assert [r.s for r in made.to_df().collect()] == ["d"]


def test_pruning_on_the_driver_and_by_spark_agree(spark, tmp_path, monkeypatch):
    made = Table.create(spark, (tmp_path / "t").as_uri(), schema(), config=Config(partitions=7))
    made.append(rows(spark, 700))
    made.append(rows(spark, 300, 5000))
    asked = [([(5, 9), (70, None)], None, 600), ([(None, 3)], 100, None), (None, 5100, 5100), ([], None, None)]
    held = [made.manifest.select(*x) for x in asked]
    monkeypatch.setattr(manifest, "CACHED", 3)
    other = Table.open(spark, made.path)
    frames = [other.manifest.select(*x) for x in asked]
    assert [sorted(r.path for r in f.collect()) if not isinstance(f, list) else f for f in frames] == held
    assert 0 < len(held[0]) < 14 and held[3] == []
    assert other.range_query(5, 9).count() == made.range_query(5, 9).count() == 50


def scanned(df):
    """Rows that the file scans of a collected frame gave."""
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            found.append(node.metrics().apply("numOutputRows").value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(plan)
    return sum(found)


def test_bloom_filters_skip_row_groups(spark, tmp_path):
    """A value within a file's bounds but not in it: with bloom filters no row is read, without them all are."""
    df = spark.range(20_000).select((F.col("id") % 100).cast("int").alias("id"), F.col("id").alias("ts"), F.lit(0.0).alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("s"))
    for name, columns, want in (("with", ["s"], 0), ("without", [], 20_000)):
        made = Table.create(spark, (tmp_path / name).as_uri(), schema(), bloom_columns=columns, config=Config(partitions=2))
        made.append(df)
        there = made.range_query(hint=("s", df.first().s))
        assert len(there.collect()) == 1
        gone = made.range_query(hint=("s", "8" * 64))
        assert gone.collect() == [] and scanned(gone) == want


def test_batch_writer(spark, tmp_path):
    made = Table.create(spark, (tmp_path / "t").as_uri(), schema())
    with BatchWriter(made, batch_rows=40, in_flight=2) as out:
        out.add_all((k % 10, k, float(k), "x") for k in range(100))
        out.flush()
        out.wait_finish()
        assert made.to_df().count() == 100
        out.add((1, 100, 1.0, "y"))
    assert made.to_df().count() == 101 and len(made.manifest.version().segments) == 4
    with pytest.raises(Exception, match="field id"):
        with BatchWriter(made) as out:
            out.add(("no number", 1, 1.0, "x"))


class Recorder:
    """Stands for a reader or writer and keeps what it was told."""

    def __init__(self):
        self.told = []

    def __getattr__(self, name):
        if name in ("read", "readStream", "write", "writeStream"):
            return self

        def call(*args, **named):
            self.told.append((name, *args, *named.items()))
            return self

        return call


def test_message_queue_options(spark, monkeypatch):
    asked = Recorder()
    readers.messages(asked, "a:1,b:2", "events", offsets_per_trigger=500, start="latest")
    assert asked.told[:5] == [("format", "kafka"), ("option", "kafka.bootstrap.servers", "a:1,b:2"), ("option", "subscribe", "events"), ("option", "startingOffsets", "latest"), ("option", "maxOffsetsPerTrigger", 500)]
    assert [x[0] for x in asked.told[5:]] == ["load", "withColumn"]
    asked = Recorder()
    readers.messages(asked, "a:1", "t", streaming=False, offsets_per_trigger=500)
    assert "maxOffsetsPerTrigger" not in [x[1] for x in asked.told if x[0] == "option"]
    sent = Recorder()
    monkeypatch.setattr(readers, "_keyed", lambda df: sent)
    readers.send(None, "a:1", "t")
    assert sent.told == [("format", "kafka"), ("option", "kafka.bootstrap.servers", "a:1"), ("option", "topic", "t"), ("save",)]
    sent.told.clear()
    readers.send_stream(None, "a:1", "t", "/c", "5 seconds")
    assert sent.told[2:] == [("option", "topic", "t"), ("option", "checkpointLocation", "/c"), ("trigger", ("processingTime", "5 seconds")), ("start",)]
    monkeypatch.undo()
    assert readers._keyed(spark.createDataFrame([(1, 2, 3)], "key int, value int, other int")).schema.simpleString() == "struct<key:string,value:string>"


def test_windows_watermark_and_rate(spark, tmp_path):
    """Windows close when the watermark passes them; a row behind it is dropped."""
    source = tmp_path / "in"
    put = lambda k, *times: spark.createDataFrame([(f"2024-01-01 00:{t}", "a") for t in times], "t string, k string").selectExpr("cast(t as timestamp) t", "k").coalesce(1).write.mode("append").parquet(str(source))
    put(0, "00:10", "00:20", "01:30")
    counts = windowed_counts(spark.readStream.schema("t timestamp, k string").parquet(str(source)), "t", "1 minute", "1 minute", "k")

    def run():
        counts.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.window.start.strftime("%M:%S"), r.k, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()) if list((tmp_path / "out").glob("*.parquet")) else []

    run()
    put(1, "00:40", "05:00")
    run()
    put(2, "00:50", "09:00")  # 00:50 is behind the watermark
    assert run() == [("00:00", "a", 3), ("01:00", "a", 1), ("05:00", "a", 1)]
    limited = rate_limited(spark, 7)
    assert limited.isStreaming and limited.columns == ["timestamp", "value"]
    for bad in (0, 200_000_000):
        with pytest.raises(ValueError):
            rate_limited(spark, bad)


def test_many_address_ranges_do_not_overflow(spark, tmp_path):
    net = Table.create(spark, (tmp_path / "n").as_uri(), TemporalSchema().add_int("ip").add_long("ts").set_index_field("ip").set_temporal_field("ts"))
    net.append(spark.createDataFrame([(2_000_000_000, 1), (-2_000_000_000, 1), (5, 1), (None, 1)], "ip int, ts long"))
    ranges = tuple((2_000_000_000 + 10 * k, 2_000_000_000 + 10 * k + 1) for k in range(10))
    assert [r.ip for r in net.run(net.query().ranges_of(ranges)).collect()] == [2_000_000_000]
    near = tuple((5 + 10 * k, 5 + 10 * k) for k in range(10))
    assert [r.ip for r in net.run(net.query().ranges_of(near)).collect()] == [5]


def test_geo_query_on_cell_borders(spark, tmp_path):
    """A geo query gives what the shape alone gives, points on borders of cells included."""
    rng = random.Random(3)
    for k in range(3):
        grid = Grid(0, 1, 0, 1, 10)
        points = [(i / 10, j / 10) for i in range(11) for j in range(11)] + [(rng.random(), rng.random()) for _ in range(50)]
        df = spark.createDataFrame(points, "longitude double, latitude double").withColumns({"zcode": grid.zcode("longitude", "latitude"), "ts": F.lit(1).cast("long")})
        made = Table.create(spark, (tmp_path / f"g{k}").as_uri(), TemporalSchema.of(df, "zcode", "ts"), grid=grid)
        made.append(df)
        for _ in range(4):
            a, b, c, d = (rng.randint(0, 10) / 10 for _ in range(4))
            box = Rectangle(a, b, c, d)
            own = df.where(box.contains("longitude", "latitude")).count()
            assert made.geo_query(box).count() == own
            assert made.geo_query(box, exact=False).count() >= own


def test_balance(spark, tmp_path):
    made = Table.create(spark, (tmp_path / "t").as_uri(), schema(), config=Config(intervals=100))
    made.append(rows(spark, 1000))
    assert made.balance(0, 100, 4) == (0.0, None)
    made.append(rows(spark, 1000).withColumn("id", F.lit(3)))
    skew, plan = made.balance(0, 100, 4)
    assert round(skew, 6) == 1.5 and len(plan) == 100 and plan[3] == 0 and plan[4] == 1


def test_records_of_other_types(spark):
    s = T.StructType().add("d", "decimal(10,2)").add("on", "date").add("at", "timestamp").add("b", "boolean")
    found = parse(spark.createDataFrame([('{"d": 1.25, "on": "2024-01-02", "at": "2024-01-02 03:04:05", "b": true}',), ('{"d": "x"}',), ('{"on": "2024-13-01"}',)], "value string"), s)
    r = found.rows.first()
    assert (str(r.d), str(r.on), str(r["at"]), r.b) == ("1.25", "2024-01-02", "2024-01-02 03:04:05", True) and found.rejected.count() == 2


def test_replayed_loops_and_cli_parts(spark, tmp_path):
    (tmp_path / "t.csv").write_text("1,2008-02-02 15:36:08,116.5,39.9\n")
    assert readers.traces(spark, str(tmp_path / "t.csv"), replay=True, loops=3).count() == 3
    low, high = part(0, 1000, 0.1, random.Random(1))
    assert 0 <= low < high <= 1000 and round(high - low, 6) == 100
    with pytest.raises(ValueError):
        part(None, 5, 0.1, random.Random(1))
