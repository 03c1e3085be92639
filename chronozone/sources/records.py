"""JSON records: integrity checks, conversion to rows and back, with rejected records kept apart."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import PATTERN, format_millis, parse_millis
from ..schema import TemporalSchema

_NAMES = {T.IntegerType(): "int", T.LongType(): "bigint", T.DoubleType(): "double", T.FloatType(): "float", T.ShortType(): "smallint", T.ByteType(): "tinyint", T.StringType(): "string", T.BooleanType(): "boolean"}


@dataclass(frozen=True)
class Parsed:
    """Rows that were read, and the records that weren't with the reason."""

    rows: DataFrame
    rejected: DataFrame


def _map(text: Column) -> Column:
    """A JSON object as a map of text; null if it is none."""
    return F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"})


def parse(df: DataFrame, schema: TemporalSchema | T.StructType, column: str = "value", datetime_field: str | None = None, required: tuple[str, ...] = ()) -> Parsed:
    """Rows of a schema from JSON text.

    An unknown attribute or a value that isn't of its field's type rejects a record; a missing attribute is null.
    ``datetime_field`` is text ``yyyy-MM-dd HH:mm:ss`` in the record and milliseconds in the row, and has to be there, as
    have the ``required`` fields.  A null record is rejected.
    """
    struct = schema.struct if isinstance(schema, TemporalSchema) else schema
    text = F.col(column).cast("string")
    staged = df.select(text.alias("record")).withColumn("m", F.when(F.trim("record").startswith("{"), _map(F.col("record"))))
    values, bad = {}, []
    for f in struct.fields:
        raw = F.col("m")[f.name]
        if f.name == datetime_field:
            values[f.name] = parse_millis(raw).cast(f.dataType)
            bad.append(values[f.name].isNull())
        else:
            values[f.name] = raw.try_cast(_NAMES.get(f.dataType, f.dataType.simpleString()))
            bad.append(raw.isNotNull() & values[f.name].isNull())
            if f.name in required:
                bad.append(raw.isNull())
    unknown = F.size(F.array_except(F.map_keys("m"), F.array(*map(F.lit, struct.names)))) > 0
    wrong = F.lit(False)
    for b in bad:
        wrong = wrong | b
    reason = F.when(F.col("m").isNull(), "not an object").when(unknown, "unknown attribute").when(wrong, "missing or malformed value")
    marked = staged.withColumn("reason", reason)
    return Parsed(marked.where("reason is null").select(*[c.alias(n) for n, c in values.items()]), marked.where("reason is not null").select("record", "reason"))


def to_json(df: DataFrame, schema: TemporalSchema, readable: bool = False, grid_field: str = "zcode", name: str = "value") -> DataFrame:
    """A column of JSON records; ``readable`` leaves the grid code out and writes the time as text."""
    columns = []
    for f in schema.struct.fields:
        if readable and f.name == grid_field:
            continue
        columns.append(format_millis(f.name, PATTERN).alias(f.name) if readable and f.name == schema.temporal_field else F.col(f.name))
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias(name))
