"""Services over a table of device positions: current positions, positions in a shape, tracks."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.geo import parse_shape
from .functions.scalar import recent_bounds
from .operators.aggregates import Count
from .operators.predicates import all_equal
from .operators.query import paged
from .plans.table import Table

RECENT_SECONDS = 600


def _answer(result: Any = None, code: str | None = None, message: str | None = None, **more: Any) -> str:
    return json.dumps({"success": code is None, "result": result, "errorCode": code, "errorMsg": message, **more}, default=str)


def current_positions(table: Table, seconds: int = RECENT_SECONDS, now_millis: int | None = None) -> DataFrame:
    """All rows of the last seconds."""
    return table.range_query(None, None, *recent_bounds(seconds, now_millis))


def positions_json(table: Table, page: int = 1, rows: int | None = None, order: list[str] | None = None, **how: Any) -> str:
    """A page of the current positions (of ``Config.page_rows`` rows if not said), newest first, with totals."""
    wanted = order or [f"-{table.schema.temporal_field}", *table.schema.names]
    found = paged(current_positions(table, **how), page, rows or table.config.page_rows, wanted)
    return _answer([json.loads(r) for r in found.rows.toJSON().collect()], page=found.page, total=found.total, totalPage=found.pages)


def count_in_shape(table: Table, shape: str | dict, device: str | None = None, seconds: int = RECENT_SECONDS, now_millis: int | None = None, device_field: str = "devid", **columns: str) -> str:
    """The number of recent rows in a shape, of one device if given; errors 1001 (format) and 1002 (missing value)."""
    try:
        parsed = parse_shape(shape)
    except ValueError as error:
        code, _, message = str(error).partition(": ")
        return _answer(None, code, message)
    only = all_equal(**{device_field: device}) if device else None
    found = table.geo_query(parsed, *recent_bounds(seconds, now_millis), where=only, aggs=[Count(alias="n")], **columns)
    return _answer(found.first().n)


def track(table: Table, start: Any, end: Any, order: str | None = None, **equal: Any) -> DataFrame:
    """Rows of one device (by equality of the named columns) in a closed time range, by time."""
    return table.range_query(None, None, start, end, where=all_equal(**equal), order_by=[order or table.schema.temporal_field])


def track_page(table: Table, start: Any, end: Any, page: int, rows: int | None, order: list[str], **equal: Any) -> str:
    """A page of a track (of ``Config.page_rows`` rows if not said), with totals and the filters."""
    rows = rows or table.config.page_rows
    found = paged(table.range_query(None, None, start, end, where=all_equal(**equal)), page, rows, order)
    return _answer([json.loads(r) for r in found.rows.toJSON().collect()], page=found.page, total=found.total, totalPage=found.pages, startTime=start, endTime=end, **equal)


def activity(df: DataFrame, time: str, by: str) -> DataFrame:
    """First, last and number of rows of each value of a column."""
    return df.groupBy(by).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("n"))
