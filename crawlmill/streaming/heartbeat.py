"""Watching for streams that stand still."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class Heartbeat(StreamingQueryListener):
    """Keeps the time and figures of each stream's last progress; 0 minutes or less never report a stall."""

    def __init__(self, minutes: float, clock: Callable[[], float] = time.monotonic):
        self.minutes, self.clock = minutes, clock
        self.last: dict[str, float] = {}
        self.rows: list[tuple[str, int, int, float]] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.last[str(event.id)] = self.clock()

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.last[str(p.id)] = self.clock()
        self.rows.append((str(p.id), p.batchId, p.numInputRows, float(p.batchDuration)))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.last[str(event.id)] = self.clock()

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.last.pop(str(event.id), None)

    def stalled(self) -> list[str]:
        """Streams without progress for longer than allowed."""
        if self.minutes <= 0:
            return []
        return [q for q, at in self.last.items() if self.clock() - at > self.minutes * 60]

    def progress(self, spark: SparkSession) -> DataFrame:
        """(stream, batch, rows, ms) of the batches seen so far."""
        return spark.createDataFrame(self.rows, "stream string, batch long, rows long, ms double")
