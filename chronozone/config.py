"""Settings, with overrides from a mapping or a simple YAML file."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Config:
    #: Rows of a chunk file at most, and the Parquet codec.
    chunk_rows: int = 4_000_000
    codec: str = "zstd"
    #: Key partitions of an append; 0 lets adaptive execution choose.
    partitions: int = 0
    #: Files that a pruned read may name; beyond that the scan's own statistics do the pruning.
    listed_files: int = 20_000
    remove_interval_hours: float = 6.0
    keep_hours: float = 24.0
    intervals: int = 1024
    skew_threshold: float = 0.2
    load_balance: bool = True
    hot_cache: bool = True
    page_rows: int = 4096
    bloom_entries: int = 1_048_576
    bloom_fpp: float = 0.03

    def override(self, values: Mapping[str, object]) -> Config:
        """A copy with other values; an unknown name is an error, and text is read as the field's type."""
        kinds = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        if unknown := set(values) - set(kinds):
            raise ValueError(f"no settings {sorted(unknown)}")
        return replace(self, **{k: _read(v, kinds[k]) for k, v in values.items()})

    @classmethod
    def from_file(cls, path: str | Path) -> Config:
        """Settings from lines ``name: value``; ``#`` begins a comment."""
        values = {}
        for line in Path(path).read_text().splitlines():
            line = line.split("#", 1)[0].strip()
            if line and line != "---":
                name, _, value = line.partition(":")
                values[name.strip().replace("-", "_")] = value.strip().strip("\"'")
        return cls().override(values)


def _read(value: object, kind: type) -> object:
    if kind is bool and isinstance(value, str):
        if value.lower() not in ("true", "false", "yes", "no", "on", "off", "1", "0"):
            raise ValueError(f"no truth value: {value}")
        return value.lower() in ("true", "yes", "on", "1")
    return kind(value)
