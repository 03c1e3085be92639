import pytest
from pyspark.sql import functions as F

from chronozone.operators.aggregates import Avg, Count, Custom, Max, Min, Sum, aggregate
from chronozone.operators.predicates import all_equal, between, compare, keep
from chronozone.operators.query import RangeQuery, batches, page, paged, sorted_rows

PEOPLE = [(1, 1, 180), (2, 2, 176), (3, 2, 172), (4, 3, 183), (5, 3, 167)]
AGG3 = [(1, 1.0, 1), (2, 2.0, 2), (2, 1.0, 2), (3, 3.0, 2), (3, 1.0, 3)]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def e2e(spark):
    n = 10_000
    return spark.range(n).select((F.col("id") % 100).cast("int").alias("a1"), (F.col("id") % 100).cast("double").alias("a2"), F.floor(F.col("id") / 100).alias("timestamp"), F.concat(F.lit("payload "), F.col("id") % 100).alias("a4"))


def test_scalar_aggregate_of_nothing_is_one_row(spark):
    df = spark.createDataFrame([], "id int, g int, height int")
    assert rows(aggregate(df, None, [Count(), Sum("height"), Max("height"), Min("height")])) == [(0, None, None, None)]
    assert rows(aggregate(df, "g", [Count()])) == []


def test_grouped_aggregates(spark):
    df = spark.createDataFrame(PEOPLE, "id int, g int, height int")
    out = aggregate(df, "g", [Count(), Sum("height"), Max("height"), Min("height")])
    assert out.columns == ["g", "count(*)", "sum(height)", "max(height)", "min(height)"]
    assert rows(out) == [(1, 1, 180.0, 180, 180), (2, 2, 348.0, 176, 172), (3, 2, 350.0, 183, 167)]


def test_types_of_aggregates(spark):
    df = spark.createDataFrame(AGG3, "c1 int, c2 double, c3 long")
    out = aggregate(df, "c1", [Count(), Sum("c2"), Max("c2"), Max("c3"), Min("c3"), Sum("c3")])
    assert [t for _, t in out.dtypes] == ["int", "bigint", "double", "double", "bigint", "bigint", "double"]
    assert rows(out) == [(1, 1, 1.0, 1.0, 1, 1, 1.0), (2, 2, 3.0, 2.0, 2, 2, 4.0), (3, 2, 4.0, 3.0, 3, 2, 5.0)]
    assert rows(aggregate(df, None, [Count(), Sum("c2"), Max("c2"), Max("c3"), Min("c3"), Sum("c3")])) == [(5, 8.0, 3.0, 3, 1, 10.0)]
    assert rows(aggregate(df, None, [Avg("c3", "m"), Custom("c1", "d", F.count_distinct("c1"))])) == [(2.0, 3)]


def test_null_group_and_nulls_in_aggregates(spark):
    df = spark.createDataFrame([(None, 1), (None, None), (1, None)], "g int, v int")
    assert sorted(rows(aggregate(df, "g", [Count(alias="n"), Sum("v", "s")])), key=str) == [(1, 1, None), (None, 2, 1.0)]
    assert aggregate(df, "g", []).count() == 2
    with pytest.raises(ValueError):
        aggregate(df, None, [])


@pytest.mark.parametrize(("low", "high", "want"), [(None, None, 10_000), (0, 99, 10_000), (0, 100, 10_000), (0, 49, 5_000), (0, 0, 100), (5, 2, 0)])
def test_key_ranges(e2e, low, high, want):
    assert RangeQuery("a1", "timestamp").between(low, high).to_df(e2e).count() == want


@pytest.mark.parametrize(("start", "end", "want"), [(None, None, 10_000), (0, 49, 5_000), (0, 0, 100)])
def test_time_ranges(e2e, start, end, want):
    assert RangeQuery("a1", "timestamp").during(start, end).agg(None, Count(alias="n")).to_df(e2e).first().n == want


def test_hints_filter_rows(e2e):
    q = RangeQuery("a1", "timestamp").between(0, 49)
    assert q.hint("a4", "payload 0").to_df(e2e).count() == 100
    assert q.hint("a2", 0.0).to_df(e2e).count() == 100


def test_having_and_mapper_and_sort(e2e):
    q = RangeQuery("a1", "timestamp").agg("a1", Count(alias="n"), Max("twice", "hi")).having(F.col("hi") < 20).sort("-a1")
    assert [r.a1 for r in q.to_df(e2e.withColumn("twice", F.col("a2") * 2)).collect()] == list(range(9, -1, -1))


def test_many_intervals_equal_their_union(e2e):
    ranges = tuple((k, k + (k % 3)) for k in range(0, 90, 7))
    want = sum(any(a <= i % 100 <= b for a, b in ranges) for i in range(10_000))
    assert RangeQuery("a1", "timestamp", ranges=ranges).to_df(e2e).count() == want
    assert RangeQuery("a1", "timestamp", ranges=()).to_df(e2e).count() == 0


def test_callable_predicates_run_after_columns(e2e):
    q = RangeQuery("a1", "timestamp").where(lambda r: r["a1"] % 2 == 0).where("a2 < 10")
    assert q.to_df(e2e).count() == 500


def test_predicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "k int, s string")
    assert rows(keep(df, all_equal(s="a")).select("k")) == [(1,), (3,)]
    assert keep(df, ~all_equal(s="a")).count() == 1
    assert keep(df, compare("k", ">=", 2)).count() == 2
    assert between("k") is None
    with pytest.raises(ValueError):
        compare("k", "!=", 2)


def test_conditions_reach_the_scan(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("k"), F.col("id").alias("t"), F.lit("x").alias("wide")).write.parquet(str(tmp_path / "x"))
    df = RangeQuery("k", "t").between(5, 9).during(0, 7).agg(None, Count(alias="n")).to_df(spark.read.parquet(str(tmp_path / "x")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k,5)" in plan and "GreaterThanOrEqual(t," in plan and "wide" not in plan
    assert df.first().n == 3


def test_pages_and_batches(spark):
    df = spark.range(25)
    assert [r.id for r in page(df, 3, 10, ["id"]).collect()] == [20, 21, 22, 23, 24]
    found = paged(df, 1, 10, ["-id"])
    assert (found.total, found.pages, found.rows.first().id) == (25, 3, 24)
    assert [len(x) for x in batches(df, 10)] == [10, 10, 5]
    assert [r.id for r in sorted_rows(spark.range(4), lambda a, b: b.id - a.id)] == [3, 2, 1, 0]
    with pytest.raises(ValueError):
        page(df, 0, 10, ["id"])
