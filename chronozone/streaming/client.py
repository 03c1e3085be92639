"""Rows from a program into a table, in batches with a bound on those in flight."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from threading import BoundedSemaphore
from typing import Any

from ..plans.table import Table


class BatchWriter:
    """Appends rows to a table, ``batch_rows`` at a time and at most ``in_flight`` batches at once.

    ``add`` waits while that many are being written, so a fast producer is held back and memory stays bounded.  ``flush``
    sends what is held, ``wait_finish`` waits until all is visible and raises what went wrong.  Usable in a ``with`` statement.
    """

    def __init__(self, table: Table, batch_rows: int = 10_000, in_flight: int = 4):
        if batch_rows < 1 or in_flight < 1:
            raise ValueError("a batch has a row at least, and one batch is in flight at least")
        self.table, self.batch_rows = table, batch_rows
        self._held: list[Sequence[Any]] = []
        self._free, self._pool = BoundedSemaphore(in_flight), ThreadPoolExecutor(in_flight)
        self._sent: list[Future] = []

    def add(self, row: Sequence[Any]) -> None:
        """Hold a row, its values in the order of the schema."""
        self._held.append(row)
        if len(self._held) >= self.batch_rows:
            self.flush()

    def add_all(self, rows: Iterable[Sequence[Any]]) -> None:
        for row in rows:
            self.add(row)

    def _write(self, rows: list[Sequence[Any]]) -> None:
        try:
            self.table.append(self.table.spark.createDataFrame(rows, self.table.schema.struct))
        finally:
            self._free.release()

    def flush(self) -> None:
        """Send the held rows without waiting for them."""
        if self._held:
            rows, self._held = self._held, []
            self._free.acquire()
            self._sent = [f for f in self._sent if not f.done() or f.exception()]
            self._sent.append(self._pool.submit(self._write, rows))

    def wait_finish(self) -> None:
        self.flush()
        sent, self._sent = self._sent, []
        for f in sent:
            f.result()

    def __enter__(self) -> BatchWriter:
        return self

    def __exit__(self, kind, *_) -> None:
        try:
            if kind is None:
                self.wait_finish()
        finally:
            self._pool.shutdown()
