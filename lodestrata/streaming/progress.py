"""Progress of a running job: counts taken in flight, and what each micro-batch did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener


def observed(df: DataFrame, matched: Column, name: str = "progress") -> tuple[DataFrame, Observation]:
    """``df`` unchanged, and an observation whose ``get`` has ``scanned`` and ``matched`` after an
    action over it. The counts are taken as rows pass; nothing is read twice."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("scanned"), F.count_if(matched).alias("matched")), seen


class Progress(StreamingQueryListener):
    """Rows, rates and ends of the streaming queries of a session.

    ``batches`` has (query name, batch number, rows read, rows a second); ``ended`` has
    (query id, error or None). Register it with ``spark.streams.addListener``.
    """

    def __init__(self) -> None:
        self.batches: list[tuple[str | None, int, int, float]] = []
        self.ended: list[tuple[str, str | None]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.append((p.name, p.batchId, p.numInputRows, p.processedRowsPerSecond))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.append((str(event.id), event.exception))
