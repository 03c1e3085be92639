"""Aggregate functions of a query and their names."""

from __future__ import annotations

from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Aggregate:
    """A function over a field; the result is named ``function(field)`` unless ``alias`` says otherwise."""

    field: str | None = None
    alias: str | None = None
    function: ClassVar[str] = ""

    def name(self) -> str:
        return self.alias or f"{self.function}({self.field})"

    def column(self) -> Column:
        raise NotImplementedError

    def named(self) -> Column:
        return self.column().alias(self.name())


class Count(Aggregate):
    """Rows of the group, as a long."""

    function = "count"

    def name(self) -> str:
        return self.alias or "count(*)"

    def column(self) -> Column:
        return F.count(F.lit(1))


class Sum(Aggregate):
    """Sum as a double; nulls are skipped, and null if there is nothing else."""

    function = "sum"

    def column(self) -> Column:
        return F.sum(F.col(self.field).cast("double"))


class Min(Aggregate):
    function = "min"

    def column(self) -> Column:
        return F.min(self.field)


class Max(Aggregate):
    function = "max"

    def column(self) -> Column:
        return F.max(self.field)


class Avg(Aggregate):
    """Mean as a double."""

    function = "avg"

    def column(self) -> Column:
        return F.avg(F.col(self.field).cast("double"))


@dataclass(frozen=True)
class Custom(Aggregate):
    """Any aggregate column, or a grouped-aggregate pandas UDF applied to the field."""

    expression: Column | None = None
    udf: object = None
    function: ClassVar[str] = "custom"

    def column(self) -> Column:
        return self.expression if self.udf is None else self.udf(F.col(self.field))


def aggregate(df: DataFrame, by: str | list[str] | None, aggs: list[Aggregate] | tuple[Aggregate, ...]) -> DataFrame:
    """Group and aggregate.

    Without a group there is just one row, also of empty input; with groups empty input has none.  A null key is a group.
    Without aggregates the distinct keys are the result.
    """
    columns = [by] if isinstance(by, str) else list(by or [])
    if not aggs:
        if not columns:
            raise ValueError("a group or an aggregate is needed")
        return df.select(*columns).distinct()
    named = [a.named() for a in aggs]
    return df.groupBy(*columns).agg(*named) if columns else df.agg(*named)
