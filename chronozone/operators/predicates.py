"""Row predicates: columns, SQL text, comparisons, Python callables and equality hints."""

from __future__ import annotations

import operator
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Predicate = Column | str | Callable[[Any], bool]
_COMPARE = {">": operator.gt, "<": operator.lt, "=": operator.eq, ">=": operator.ge, "<=": operator.le}


def compare(name: str, sign: str, value: Any) -> Column:
    """``name sign value`` with one of ``> < = >= <=``."""
    if sign not in _COMPARE:
        raise ValueError(f"no comparison {sign}")
    return _COMPARE[sign](F.col(f"`{name}`"), F.lit(value))


def all_equal(**wanted: Any) -> Column:
    """Every column equals its value; a null on either side is false, never unknown."""
    out = F.lit(True)
    for name, value in wanted.items():
        out = out & F.coalesce(F.col(name) == F.lit(value), F.lit(False))
    return out


def between(name: str, low: Any = None, high: Any = None) -> Column | None:
    """The closed interval, open on a side that is None; None if both are."""
    parts = [F.col(name) >= F.lit(low)] * (low is not None) + [F.col(name) <= F.lit(high)] * (high is not None)
    return None if not parts else parts[0] if len(parts) == 1 else parts[0] & parts[1]


def keep(df: DataFrame, predicate: Predicate | None) -> DataFrame:
    """The rows that satisfy a predicate.

    Columns and SQL text reach the scan.  A callable gets each row (attributes by name); it runs in Python on what the
    conditions before it have left, so give it last.
    """
    if predicate is None:
        return df
    if isinstance(predicate, (Column, str)):
        return df.where(predicate)
    test = F.udf(lambda row: bool(predicate(row)), "boolean", useArrow=True)
    return df.where(test(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
