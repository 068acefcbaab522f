"""Counters that come out of the work itself: a job that writes a table counts what passes by, without reading it again."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

COUNTERS = "job string, batch long, counter string, label string, n long"


def by_value(name: str, column: Column, values: Iterable[str], other: str | None = None) -> list[tuple[str, str, Column]]:
    """A counter for each of a few values of a column; other: the label of all the rest, nulls included."""
    values = list(values)
    out = [(name, v, F.count(F.when(column == v, 1))) for v in values]
    if other is not None:
        out.append((name, other, F.count(F.when(~F.coalesce(column.isin(values), F.lit(False)), 1))))
    return out


class Counted:
    """Counters over the rows of one DataFrame. They are there once a job has read it to the end."""

    def __init__(self, job: str, counters: list[tuple[str, str, Column]], batch: int = 0):
        self.job, self.batch, self.counters = job, batch, counters
        self._seen = Observation()

    def over(self, rows: DataFrame) -> DataFrame:
        """The same rows; use them in one job only."""
        return rows.observe(self._seen, *(c.alias(f"c{k}") for k, (_, _, c) in enumerate(self.counters)))

    def rows(self) -> list[tuple[str, int, str, str, int]]:
        """As in COUNTERS, without those that are zero."""
        seen = self._seen.get
        found = ((name, label, seen[f"c{k}"]) for k, (name, label, _) in enumerate(self.counters))
        return [(self.job, self.batch, name, label, n) for name, label, n in found if n]


def table(spark: SparkSession, rows: list[tuple[str, int, str, str, int]]) -> DataFrame:
    return spark.createDataFrame(rows, COUNTERS)


class Recorder(StreamingQueryListener):
    """Keeps what Spark says of each micro-batch of each query: rows read, and the metrics that observe() names.

    Add it with spark.streams.addListener(recorder)."""

    def __init__(self) -> None:
        self.found: list[tuple[str, int, str, str, int]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.found.append((p.name or str(p.id), p.batchId, "rows_read", "", p.numInputRows))
        for s in p.stateOperators:
            self.found.append((p.name or str(p.id), p.batchId, "state_rows", s.operatorName, s.numRowsTotal))
        for label, row in p.observedMetrics.items():
            self.found += [(p.name or str(p.id), p.batchId, counter, label, int(n)) for counter, n in row.asDict().items() if n is not None]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
