"""Scalar functions on columns: times, typed text, network addresses."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = "yyyy-MM-dd HH:mm:ss"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_millis(x: Column | str, pattern: str = PATTERN) -> Column:
    """Milliseconds of a date and time in the session's zone; null if it can't be read."""
    return F.unix_millis(F.try_to_timestamp(_col(x), F.lit(pattern)))


def format_millis(x: Column | str, pattern: str = PATTERN) -> Column:
    return F.date_format(F.timestamp_millis(_col(x)), pattern)


def typed(x: Column | str, kind: str) -> Column:
    """Text as int, long, double, float, short, byte or string; null if it isn't one."""
    names = {"long": "bigint", "short": "smallint", "byte": "tinyint"}
    if kind not in ("int", "long", "double", "float", "short", "byte", "string"):
        raise ValueError(f"no type {kind}")
    return _col(x).try_cast(names.get(kind, kind))


def strip_special(x: Column | str, marks: str = r"[`~!@#$%^&*()+=|{}':;\[\]<>/?\\]") -> Column:
    """Without special characters and white space at the ends."""
    return F.trim(F.regexp_replace(_col(x), marks, ""))


def delete_chars(x: Column | str, chars: str) -> Column:
    return F.translate(_col(x), chars, "")


def ipv4_to_int(x: Column | str) -> Column:
    """A dotted address as a signed 32-bit number; null if it is none."""
    x = _col(x)
    parts = F.split(x, r"\.")
    octets = [F.get(parts, F.lit(k)).try_cast("long") for k in range(4)]
    total = reduce(lambda a, b: a * 256 + b, octets)
    ok = x.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") & reduce(lambda a, b: a & b, [o <= 255 for o in octets])
    return F.when(ok, F.when(total >= 2**31, total - 2**32).otherwise(total)).cast("int")


def ipv4_value(text: str) -> int:
    """The same for a literal."""
    parts = [int(p) for p in text.split(".")]
    if len(parts) != 4 or not all(0 <= p <= 255 for p in parts):
        raise ValueError(f"no IPv4 address: {text}")
    total = reduce(lambda a, b: a * 256 + b, parts)
    return total - 2**32 if total >= 2**31 else total


def recent_bounds(seconds: int, now_millis: int | None = None) -> tuple[int, int]:
    """The closed range of the last seconds, in milliseconds."""
    now = int(time.time() * 1000) if now_millis is None else now_millis
    return now - seconds * 1000, now
