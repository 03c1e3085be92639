"""Progress of streams, system state, and phase timings."""

from __future__ import annotations

import os
import shutil
import time
from collections import deque
from contextlib import contextmanager
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..config import Config

HISTORY = 26


class Progress(StreamingQueryListener):
    """Keeps the rates of the last batches of all streams; add it by ``spark.streams.addListener``."""

    def __init__(self):
        self.history: deque[dict] = deque(maxlen=HISTORY)

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        self.history.append({"name": p.name, "batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond or 0.0})

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def system_state(spark: SparkSession, progress: Progress, config: Config, path: str = "/") -> DataFrame:
    """One row: throughput, its history, CPU load and disk share of the driver, and the settings."""
    disk = shutil.disk_usage(path)
    rates = [float(x["rows_per_second"]) for x in progress.history]
    row = (rates[-1] if rates else 0.0, rates, os.getloadavg()[0] / (os.cpu_count() or 1), disk.used / disk.total, {k: str(v) for k, v in asdict(config).items()})
    return spark.createDataFrame([row], "throughput double, history array<double>, cpu double, disk double, settings map<string,string>")


class Timings:
    """Named phases with tags: totals, and means by tag."""

    def __init__(self):
        self.rows: list[tuple[str, str, float]] = []

    @contextmanager
    def phase(self, name: str, tag: str = ""):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.rows.append((name, tag, time.perf_counter() - began))

    def total(self, name: str) -> float:
        return sum(s for n, _, s in self.rows if n == name)

    def means(self) -> dict[tuple[str, str], float]:
        out: dict[tuple[str, str], list[float]] = {}
        for n, t, s in self.rows:
            out.setdefault((t, n), []).append(s)
        return {k: sum(v) / len(v) for k, v in out.items()}
