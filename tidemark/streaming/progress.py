"""How far a stream of frames has come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Tells rows, rows a second, and how many times faster than the recording that is."""

    def __init__(self, fps: float, tell: Callable[[str], None] = print):
        self.fps, self.tell, self.rows = fps, tell, 0

    def onQueryStarted(self, event) -> None:
        self.rows = 0

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        rate = event.progress.processedRowsPerSecond or 0.0
        self.tell(f"frame {self.rows}, {rate:.1f} a second, {rate / self.fps:.2f} x real time")

    def onQueryTerminated(self, event) -> None:
        self.tell(f"{self.rows} frames")


def watch(spark: SparkSession, fps: float, tell: Callable[[str], None] = print) -> Progress:
    listener = Progress(fps, tell)
    spark.streams.addListener(listener)
    return listener
