"""Counters of streams, batch by batch, from what their queries observe."""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

PROGRESS = "query string, batch long, input_rows long, counters map<string,double>"


class Counters(StreamingQueryListener):
    """Keeps the observed metrics of each batch of the named queries; ``spark.streams.addListener``
    puts it on. A query names itself with ``queryName`` and observes with ``df.observe(name, ...)``.
    The last ``most`` batches are kept; ``failures`` has the errors queries ended with.
    """

    def __init__(self, names: list[str] | None = None, most: int = 10_000):
        super().__init__()
        self.names, self.most = names, most
        self.held: list[tuple] = []
        self.failures: dict[str, str] = {}
        self._of: dict[str, str] = {}
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        self._of[str(event.id)] = event.name

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.names is not None and p.name not in self.names:
            return
        found = {f"{name}.{k}": float(v) for name, row in p.observedMetrics.items() for k, v in row.asDict().items() if v is not None}
        with self._lock:
            self.held = [*self.held, (p.name, p.batchId, p.numInputRows, found)][-self.most :]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.failures[self._of.get(str(event.id)) or str(event.id)] = json.dumps(str(event.exception))[:1000]

    def batches(self, spark: SparkSession) -> DataFrame:
        """query, batch, input_rows, counters; a batch that ran again counts as it ran last."""
        with self._lock:
            last = {(name, n): row for row in self.held for name, n in [row[:2]]}
        return spark.createDataFrame(sorted(last.values(), key=lambda r: (r[0] or "", r[1])), PROGRESS)
