"""The query pipeline: key range, time range, predicate, aggregation, having, order."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import cmp_to_key, reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.geo import coalesced
from .aggregates import Aggregate, aggregate
from .predicates import Predicate, between, keep


#: Intervals that become a condition each, and the span of keys up to which many intervals become a bit map.
MANY, MAPPED = 8, 1 << 18


def within(key: Column, ranges: Sequence[tuple[int, int]]) -> Column:
    """Whether an integer key is in any of many closed intervals; null for a null key.

    The intervals become a bit map over their span, in 32-bit words of one literal array, so a row costs one look-up however many
    intervals there are.  Wider spans than ``MAPPED`` are searched interval by interval.  All arithmetic is on longs and never
    leaves them.
    """
    key = key.cast("long")
    own = [(lo, hi) for lo, hi in ranges if lo <= hi]
    if not own:
        return key.isNull() & F.lit(None).cast("boolean")
    low, high = min(lo for lo, _ in own), max(hi for _, hi in own)
    if high - low >= MAPPED:
        return F.exists(F.array(*[F.struct(F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi")) for lo, hi in own]), lambda r: (key >= r["lo"]) & (key <= r["hi"]))
    bits = 0
    for lo, hi in own:
        bits |= ((1 << (hi - lo + 1)) - 1) << (lo - low)
    array = F.expr(f"array({', '.join(f'{bits >> 32 * k & 0xFFFFFFFF}L' for k in range((high - low) // 32 + 1))})")
    # a key outside the span is looked up at the edge and found out by the comparison
    at = F.least(F.greatest(key, F.lit(low).cast("long")), F.lit(high).cast("long")) - F.lit(low).cast("long")
    word = F.get(array, F.shiftright(at, 5).cast("int"))
    return key.between(F.lit(low).cast("long"), F.lit(high).cast("long")) & (F.getbit(word, F.pmod(at, F.lit(32)).cast("int")) == 1)


@dataclass(frozen=True)
class RangeQuery:
    """An immutable description of a query; ``to_df`` gives one lazy plan, whatever the order of the calls.

    ``ranges`` are closed key intervals, a row being in any of them; None is all keys.  Bounds that are None are open.
    """

    key: str
    time: str
    ranges: tuple[tuple[Any, Any], ...] | None = None
    start: Any = None
    end: Any = None
    predicates: tuple[Predicate, ...] = ()
    group_by: tuple[str, ...] = ()
    aggs: tuple[Aggregate, ...] = ()
    havings: tuple[Predicate, ...] = ()
    order: tuple[str | Column, ...] = ()
    hints: tuple[tuple[str, Any], ...] = ()
    columns: tuple[str, ...] = field(default=())

    def between(self, low: Any = None, high: Any = None) -> RangeQuery:
        return replace(self, ranges=None if low is None and high is None else ((low, high),))

    def ranges_of(self, ranges: Sequence[tuple[Any, Any]]) -> RangeQuery:
        """Keys in any of several closed intervals."""
        return replace(self, ranges=tuple(ranges))

    def during(self, start: Any = None, end: Any = None) -> RangeQuery:
        return replace(self, start=start, end=end)

    def where(self, predicate: Predicate | None) -> RangeQuery:
        return self if predicate is None else replace(self, predicates=(*self.predicates, predicate))

    def agg(self, group_by: str | Sequence[str] | None, *aggs: Aggregate) -> RangeQuery:
        return replace(self, group_by=(group_by,) if isinstance(group_by, str) else tuple(group_by or ()), aggs=tuple(aggs))

    def having(self, predicate: Predicate | None) -> RangeQuery:
        return self if predicate is None else replace(self, havings=(*self.havings, predicate))

    def sort(self, *order: str | Column) -> RangeQuery:
        """Columns, names, or names with a leading ``-`` for descending order; nulls come last either way."""
        return replace(self, order=order)

    def hint(self, name: str, value: Any) -> RangeQuery:
        """Rows have this value in that column; it is a filter, so statistics and bloom filters skip whole row groups."""
        return replace(self, hints=(*self.hints, (name, value)))

    def select(self, *columns: str) -> RangeQuery:
        return replace(self, columns=columns)

    def condition(self) -> Column | None:
        """Key and time as one column, in the form that Parquet scans take."""
        parts = []
        if self.ranges is not None:
            own = [between(self.key, lo, hi) for lo, hi in self.ranges]
            if not own:
                parts.append(F.lit(False))
            elif len(own) > MANY and all(isinstance(v, int) for r in self.ranges for v in r):
                # few wide intervals for the scan, then all of them in one look-up
                parts.append(reduce(lambda a, b: a | b, [between(self.key, lo, hi) for lo, hi in coalesced(self.ranges, MANY)]))
                parts.append(within(F.col(self.key), self.ranges))
            elif all(x is not None for x in own):
                parts.append(reduce(lambda a, b: a | b, own))
        if (t := between(self.time, self.start, self.end)) is not None:
            parts.append(t)
        return reduce(lambda a, b: a & b, parts) if parts else None

    def to_df(self, source: DataFrame) -> DataFrame:
        df = keep(source, self.condition())
        for name, value in self.hints:
            df = df.where(F.col(name) == F.lit(value))
        for p in sorted(self.predicates, key=lambda p: not isinstance(p, (Column, str))):  # Python last
            df = keep(df, p)
        if self.group_by or self.aggs:
            df = aggregate(df, list(self.group_by), self.aggs)
        for p in self.havings:
            df = keep(df, p)
        if self.columns:
            df = df.select(*self.columns)
        if self.order:
            df = df.orderBy(*order_columns(self.order))
        return df


def order_columns(order: Sequence[str | Column]) -> list[Column]:
    made = []
    for x in order:
        if isinstance(x, str):
            x = F.col(f"`{x[1:]}`").desc_nulls_last() if x.startswith("-") else F.col(f"`{x}`").asc_nulls_last()
        made.append(x)
    return made


def sorted_rows(df: DataFrame, compare: Callable[[Row, Row], int]) -> list[Row]:
    """Rows in the order of a comparator, on the driver: for results that are small; else sort by columns."""
    return sorted(df.collect(), key=cmp_to_key(compare))


@dataclass(frozen=True)
class Page:
    """A page of a result: its rows as a frame, and the sizes of the whole."""

    rows: DataFrame
    total: int
    page: int
    pages: int


def page(df: DataFrame, number: int, rows: int, order: Sequence[str | Column]) -> DataFrame:
    """Rows ``rows * (number - 1)`` up to ``rows * number`` of the ordered result; ``order`` has to be total for stable pages."""
    if number < 1 or rows < 1:
        raise ValueError("pages count from 1 and hold at least a row")
    return df.orderBy(*order_columns(order)).offset(rows * (number - 1)).limit(rows)


def paged(df: DataFrame, number: int, rows: int, order: Sequence[str | Column]) -> Page:
    total = df.count()
    return Page(page(df, number, rows, order), total, number, -(-total // rows))


def batches(df: DataFrame, size: int = 4096) -> Iterator[list[Row]]:
    """The result in lists of ``size`` rows, partition by partition, so the driver never holds it whole."""
    held: list[Row] = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
