"""Command line: ``python -m chronozone.cli create|ingest|query|retain|compact|state``."""

from __future__ import annotations

import argparse
import random
import sys
import time

from pyspark.sql import SparkSession

from .config import Config
from .functions.scalar import recent_bounds
from .operators.aggregates import Avg, Count, Max, Min, Sum
from .plans.table import Table
from .schema import TemporalSchema
from .sources.readers import lines
from .streaming.ingest import start_records

AGGS = {"count": Count, "sum": Sum, "min": Min, "max": Max, "avg": Avg}


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chronozone")
    p.add_argument("mode", choices=["create", "ingest", "query", "retain", "compact", "state"])
    p.add_argument("--table", required=True)
    p.add_argument("--config")
    p.add_argument("--input", help="Parquet to create from, or a folder of JSON lines to ingest")
    p.add_argument("--index")
    p.add_argument("--time")
    p.add_argument("--low", type=float)
    p.add_argument("--high", type=float)
    p.add_argument("--start")
    p.add_argument("--end")
    p.add_argument("--where")
    p.add_argument("--having")
    p.add_argument("--group")
    p.add_argument("--agg", action="append", default=[], help="count, sum:field, min:field, max:field or avg:field")
    p.add_argument("--order", action="append", default=[])
    p.add_argument("--queries", type=int, default=1, help="times to run the query")
    p.add_argument("--rows", type=int, default=20)
    p.add_argument("--before", type=int, help="retain: time before which chunks go; by the settings if not given")
    p.add_argument("--small", type=int, help="compact: only segments of fewer rows")
    p.add_argument("--selectivity", type=float, help="query: a random part of this share of --low to --high, another each time")
    p.add_argument("--recent", type=int, help="query: the last so many seconds (times in milliseconds)")
    p.add_argument("--seed", type=int, default=1000)
    p.add_argument("--files", type=int, help="ingest: input files of a batch at most")
    p.add_argument("--every", help="ingest: run on, with a batch in each such interval, as '5 seconds'")
    return p


def _bound(text: str | None):
    return int(text) if text and text.lstrip("-").isdigit() else text


def part(low: float, high: float, share: float, rng: random.Random) -> tuple[float, float]:
    """A random interval of a share of a range."""
    if not 0 < share <= 1 or low is None or high is None:
        raise ValueError("a selectivity is a share of --low to --high")
    at = low + rng.random() * (high - low) * (1 - share)
    return at, at + (high - low) * share


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("chronozone").getOrCreate()
    config = Config.from_file(a.config) if a.config else Config()
    if a.mode == "create":
        df = spark.read.parquet(a.input)
        Table.create(spark, a.table, TemporalSchema.of(df, a.index, a.time), config=config).append(df)
        return 0
    table = Table.open(spark, a.table, config=config)
    if a.mode == "ingest":
        start_records(table, lines(spark, a.input, streaming=True, files_per_trigger=a.files), table.schema, f"{a.table}/_checkpoint", f"{a.table}/_rejected", interval=a.every).awaitTermination()
    elif a.mode == "compact":
        table.compact(a.small)
    elif a.mode == "retain":
        print(table.retain(a.before), "chunks dropped")
    elif a.mode == "state":
        table.manifest.boxes().show(a.rows, False)
    else:
        aggs = [AGGS[k](f or None) for k, _, f in (x.partition(":") for x in a.agg)]
        rng = random.Random(a.seed)
        for _ in range(a.queries):
            began = time.perf_counter()
            low, high = part(a.low, a.high, a.selectivity, rng) if a.selectivity else (a.low, a.high)
            start, end = recent_bounds(a.recent) if a.recent else (_bound(a.start), _bound(a.end))
            table.range_query(low, high, start, end, where=a.where, having=a.having, group_by=a.group, aggs=aggs, order_by=a.order).show(a.rows, False)
            print(f"{time.perf_counter() - began:.3f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
