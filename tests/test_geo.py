import random

import pytest

from chronozone.functions.geo import Circle, Grid, Line, Polygon, Rectangle, coalesced, interleave_value, merged, parse_shape
from chronozone.operators import partitioning as P
from chronozone.plans import catalog


def inside(spark, shape, *points):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in points], "x double, y double")
    return [r.v for r in df.select(shape.contains("x", "y").alias("v")).collect()]


def test_codes(spark):
    assert [interleave_value(2, 4, 4), interleave_value(3, 5, 4), interleave_value(100, 100, 7)] == [36, 39, 15408]
    grid = Grid(100, 200, 150, 300, 128)
    points = [(random.Random(k).uniform(-1000, 999), random.Random(-k).uniform(-1000, 999)) for k in range(300)]
    df = spark.createDataFrame(points, "x double, y double").select("x", "y", grid.zcode("x", "y").alias("z"))
    for r in df.collect():
        assert 0 <= r.z < grid.max_zcode and r.z == grid.zcode_of(r.x, r.y)


def test_intervals():
    grid = Grid(0, 100, 0, 200, 10)
    assert grid.intervals(Rectangle(20, 80, 30, 100)) == grid.intervals(Rectangle(30, 100, 20, 80)) == [(36, 39)]
    assert merged([5, 1, 2, 2, 9]) == [(1, 2), (5, 5), (9, 9)]
    assert coalesced([(1, 2), (4, 5), (9, 9), (20, 21)], 2) == [(1, 9), (20, 21)]


def test_intervals_hold_every_point_of_a_rectangle():
    rng, grid, box = random.Random(1), Grid(0, 1024, 0, 2048, 500), Rectangle(500, 1024, 700, 1080)
    own = grid.intervals(box)
    for _ in range(1000):
        x, y = rng.uniform(0, 1024), rng.uniform(0, 2048)
        hit = any(a <= grid.zcode_of(x, y) <= b for a, b in own)
        assert hit or not (500 <= x <= 700 and 1024 <= y <= 1080)


def test_cells_on_borders_and_random_grids(spark):
    """The grid's cells and those of the column form are the same, on borders too."""
    rng = random.Random(7)
    for _ in range(12):
        low, cells = rng.choice([0.0, 0.1, -3.3, 111.0]), rng.choice([3, 7, 10, 100, 128])
        grid = Grid(low, low + rng.choice([1.0, 0.7, 4.0]), low, low + rng.choice([0.3, 1.0, 5.0]), cells)
        xs = [grid.x1 + (grid.x2 - grid.x1) * k / cells for k in range(cells + 1)]
        ys = [round(grid.y1 + (grid.y2 - grid.y1) * k / cells, 3) for k in range(cells + 1)]
        points = list(zip(xs, ys)) + [(float("inf"), float("-inf"))]
        rows = spark.createDataFrame(points, "x double, y double").select("x", "y", grid.zcode("x", "y").alias("z")).collect()
        assert [r.z for r in rows] == [grid.zcode_of(r.x, r.y) for r in rows]
    ids = spark.range(41).selectExpr("id / 20D as k").select("k", P.interval_id("k", 0, 2, 20).alias("i")).collect()
    assert [r.i for r in ids] == [P.interval_of(r.k, 0, 2, 20) for r in ids]


def test_shapes(spark):
    assert inside(spark, Rectangle(0, 2, 2, 0), (1, 1), (0, 3), (1, 2)) == [True, False, True]
    assert inside(spark, Circle(1, 0, 1), (1, 0), (1, 2), (1, 1)) == [True, False, True]
    polygon = Polygon(((1, 3), (2, 8), (5, 4), (5, 9), (7, 5), (6, 1), (3, 1)))
    assert inside(spark, polygon, (1, 3), (0, 0), (2, 2)) == [True, False, True]
    assert polygon.bbox().x1 == 1.0 and Circle(1, 0, 1).bbox().x1 == 0.0
    assert Line(0, 1, 2, 5).slope == 2 and Line(0, 1, 2, 5).intercept == 1 and Line(1, 0, 1, 9).vertical
    with pytest.raises(ValueError):
        Polygon(((0, 0), (1, 1)))


def test_polygon_edges(spark):
    """Left edges and level lower ones belong to a polygon and others don't, so of polygons side by side one holds each point."""
    square = Polygon(((0, 0), (2, 0), (2, 2), (0, 2)))
    assert inside(spark, square, (0, 1), (1, 0), (0, 0)) == [True] * 3
    assert inside(spark, square, (2, 1), (1, 2), (2, 0), (0, 2), (2, 2)) == [False] * 5
    corners, middle = ((0, 0), (3, 0), (3.5, 2), (1, 3), (-0.7, 1.1)), (1.3, 1.2)
    points = [(k / 20, j / 20) for k in range(-20, 80) for j in range(-5, 65)] + [((a + c * k) / (1 + k), (b + d * k) / (1 + k)) for a, b in corners for c, d in (*corners, middle) for k in range(4)]
    parts = [inside(spark, Polygon((a, b, middle)), *points) for a, b in zip(corners, corners[1:] + corners[:1])]
    assert [sum(x) for x in zip(*parts)] == [int(x) for x in inside(spark, Polygon(corners), *points)]


def test_polygon_query_gives_what_its_sql_does(spark, tmp_path):
    """Event 47,500 lies on a right edge of the query's polygon and event 195,000 on its lowest corner."""
    duckdb = pytest.importorskip("duckdb")
    df = spark.range(500).union(spark.createDataFrame([(47_500,), (195_000,), (247_500,)], "id long")).withColumnRenamed("id", "event_id")
    df.selectExpr("event_id", "event_id % 100 as user_id", "timestamp_ntz '2024-01-01' as ts", "'click' as event_type", "1D as value").write.parquet(str(tmp_path / "events.parquet"))
    found = sorted(r.event_id for r in catalog.QUERIES["geo_polygon"](spark, str(tmp_path)).collect())
    sql = duckdb.connect().execute(f"WITH events AS (SELECT * FROM '{tmp_path}/events.parquet/*.parquet') {catalog.ORACLE_SQL['geo_polygon']}").fetchall()
    assert found == sorted(x for x, in sql) and 0 < len(found) < 500 and not {47_500, 195_000, 247_500} & set(found)


def test_parsing():
    assert parse_shape('{"type": "rectangle", "leftTop": "1,5", "rightBottom": "4,2"}') == Rectangle(1, 5, 4, 2)
    assert parse_shape({"type": "circle", "longitude": 1, "latitude": "2", "radius": 3}) == Circle(1, 2, 3)
    assert parse_shape({"type": "polygon", "geoStr": ["1 2", "3 4", "5 0"]}) == Polygon(((1, 2), (3, 4), (5, 0)))
    for bad, code in (("x", "1001"), ("{}", "1002"), ('{"type": "star"}', "1001"), ('{"type": "circle", "longitude": 1, "latitude": 2}', "1002"), ('{"type": "rectangle", "leftTop": "a,b", "rightBottom": "1,2"}', "1001")):
        with pytest.raises(ValueError, match=code):
            parse_shape(bad)


def test_partitioning(spark):
    assert (P.interval_of(-100, 0, 100, 16), P.interval_of(2330, 0, 100, 16)) == (0, 15)
    plan = P.equal_plan(10, 100)
    df = spark.range(100).select(P.partition_id(P.interval_id("id", 0, 100, 100), plan).alias("p"), "id")
    assert all(r.p == r.id // 10 for r in df.collect())
    assert P.repartition_plan([300, 300, 500, 50, 50, 200, 200, 100, 200, 100], 4) == [0, 0, 1, 2, 2, 2, 2, 3, 3, 3]
    assert P.skew_factor([1, 1, 4]) == 1.0 and P.skew_factor([]) == 0.0
    assert P.rebalanced([1] * 8, P.equal_plan(4, 8), 4) is None
    assert P.rebalanced([9, 9, 1, 1, 1, 1, 1, 1], P.equal_plan(4, 8), 4) is not None
    hist = P.histogram(spark.range(10), "id", 0, 20, 4)
    assert P.weights(P.merge_histograms(hist, hist), 4) == [10, 10, 0, 0]
