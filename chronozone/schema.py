"""Schemas with two roles: one indexing field and one temporal field."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_SIZES = {T.IntegerType(): 4, T.LongType(): 8, T.DoubleType(): 8, T.FloatType(): 4, T.ShortType(): 2, T.ByteType(): 1}


class TemporalSchema:
    """A struct with the names of its index and temporal fields; built by ``add_*`` calls or from a ``StructType``."""

    def __init__(self, struct: T.StructType | None = None, index_field: str | None = None, temporal_field: str | None = None):
        self.struct = T.StructType(list(struct.fields) if struct else [])
        self.index_field = self.temporal_field = None
        if index_field:
            self.set_index_field(index_field)
        if temporal_field:
            self.set_temporal_field(temporal_field)

    def _add(self, name: str, kind: T.DataType, metadata: dict | None = None) -> TemporalSchema:
        if name in self.struct.names:
            raise ValueError(f"field {name} is there already")
        self.struct = T.StructType([*self.struct.fields, T.StructField(name, kind, True, metadata or {})])
        return self

    def add_int(self, name: str) -> TemporalSchema:
        return self._add(name, T.IntegerType())

    def add_long(self, name: str) -> TemporalSchema:
        return self._add(name, T.LongType())

    def add_double(self, name: str) -> TemporalSchema:
        return self._add(name, T.DoubleType())

    def add_varchar(self, name: str, length: int) -> TemporalSchema:
        """A string; its length is kept as metadata and not enforced."""
        return self._add(name, T.StringType(), {"length": length})

    def _role(self, name: str) -> str:
        if name not in self.struct.names:
            raise ValueError(f"no field {name}")
        return name

    def set_index_field(self, name: str) -> TemporalSchema:
        if not isinstance(self.struct[self._role(name)].dataType, T.NumericType):
            raise ValueError("the index field is a number")
        self.index_field = name
        return self

    def set_temporal_field(self, name: str) -> TemporalSchema:
        if not isinstance(self.struct[self._role(name)].dataType, (T.LongType, T.IntegerType, T.TimestampType, T.TimestampNTZType)):
            raise ValueError("the temporal field is a long or a timestamp")
        self.temporal_field = name
        return self

    @property
    def names(self) -> list[str]:
        return self.struct.names

    def field_index(self, name: str) -> int:
        return self.struct.names.index(name) if name in self.struct.names else -1

    def value(self, name: str, row: tuple | list) -> Any:
        """A row's value of a field; None for an unknown field."""
        k = self.field_index(name)
        return None if k < 0 else row[k]

    def tuple_length(self) -> int:
        """Bytes of a row: fixed sizes, and the declared length of strings."""
        return sum(f.metadata.get("length", 0) if isinstance(f.dataType, T.StringType) else _SIZES.get(f.dataType, 8) for f in self.struct.fields)

    def duplicate(self) -> TemporalSchema:
        return TemporalSchema(self.struct, self.index_field, self.temporal_field)

    def __eq__(self, other: object) -> bool:
        kinds = lambda s: [(f.name, f.dataType) for f in s.struct.fields]
        return isinstance(other, TemporalSchema) and kinds(self) == kinds(other) and (self.index_field, self.temporal_field) == (other.index_field, other.temporal_field)

    __hash__ = None

    def __str__(self) -> str:
        roles = {self.index_field: " (index)", self.temporal_field: " (time)"}
        return ", ".join(f"{f.name} {f.dataType.simpleString()}{roles.get(f.name, '')}" for f in self.struct.fields)

    def to_json(self) -> str:
        return json.dumps({"struct": self.struct.jsonValue(), "index": self.index_field, "time": self.temporal_field})

    @classmethod
    def from_json(cls, text: str) -> TemporalSchema:
        x = json.loads(text)
        return cls(T.StructType.fromJson(x["struct"]), x["index"], x["time"])

    @classmethod
    def of(cls, df: DataFrame, index_field: str, temporal_field: str) -> TemporalSchema:
        return cls(df.schema, index_field, temporal_field)

    def check(self) -> TemporalSchema:
        """Self, if both roles are set."""
        if not self.index_field or not self.temporal_field:
            raise ValueError("a stored schema has an index field and a temporal field")
        return self

    def conform(self, df: DataFrame) -> DataFrame:
        """The frame's columns by name, cast to the schema's types."""
        return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in self.struct.fields])
