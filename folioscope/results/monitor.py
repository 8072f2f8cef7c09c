"""What was searched, how long it took, and what was slow."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass
class Event:
    name: str
    seconds: float
    rows: int | None = None


@dataclass
class Monitor:
    """A ring of recent searches; those beyond ``slow`` seconds are kept apart."""

    slow: float = 1.0
    recent: deque[Event] = field(default_factory=lambda: deque(maxlen=1000))
    slowest: deque[Event] = field(default_factory=lambda: deque(maxlen=100))

    @contextmanager
    def search(self, spark: SparkSession, name: str, timeout: float | None = None) -> Iterator[Event]:
        """Run a search as a job group, which ``timeout`` cancels."""
        import threading

        sc = spark.sparkContext
        sc.setJobGroup(name, name, interruptOnCancel=True)
        timer = threading.Timer(timeout, sc.cancelJobGroup, [name]) if timeout else None
        if timer:
            timer.start()
        event, began = Event(name, 0.0), time.perf_counter()
        try:
            yield event
        finally:
            if timer:
                timer.cancel()
            event.seconds = time.perf_counter() - began
            self.recent.append(event)
            if event.seconds > self.slow:
                self.slowest.append(event)

    def log(self, spark: SparkSession, path: str) -> None:
        """Add the slow searches to a table, and forget them."""
        rows = [(e.name, e.seconds, e.rows) for e in self.slowest]
        if rows:
            spark.createDataFrame(rows, "name string, seconds double, rows long").coalesce(1).write.mode("append").json(path)
        self.slowest.clear()

    def summary(self) -> dict[str, float]:
        times = sorted(e.seconds for e in self.recent)
        if not times:
            return {"searches": 0}
        return {"searches": len(times), "mean": sum(times) / len(times), "median": times[len(times) // 2], "p99": times[int(0.99 * (len(times) - 1))]}
