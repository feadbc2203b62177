"""Workers of orchestrating sessions, watched as their events come in."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOUR_MS = 3_600_000
SPAWNED = "worker_spawned"
ENDS = ("worker_exited", "worker_failed", "worker_timeout")


class WorkerWatch(StatefulProcessor):
    """Pairs the i-th worker of a session with the i-th end in it. An end gives a row; a worker without one gives a row when
    stale_ms of event time have gone by since its start, once, and another if its end comes after all. A session's events come
    in order of id from batch to batch, as its log is only added to; within a batch they are sorted here.

    State: the open workers, ends that wait for their worker, and three numbers. A timer drops all of a session's state when
    keep_ms have gone by since its last event."""

    SCHEMA = "fleet string, session string, n long, ts long, model string, outcome string, took long"

    def __init__(self, stale_ms: int = 6 * HOUR_MS, keep_ms: int = 14 * 24 * HOUR_MS):
        self.stale_ms, self.keep_ms = stale_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "spawned long, ended long, seen long")
        self.open = handle.getMapState("open", "n long", "ts long, model string, stale boolean")
        self.early = handle.getMapState("early", "n long", "kind string, took long")

    def _rows(self, key, rows: list[tuple]) -> Iterator[Row]:
        for n, ts, model, outcome, took in rows:
            yield Row(fleet=key[0], session=key[1], n=n, ts=ts, model=model, outcome=outcome, took=took)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        spawned, ended, seen = self.counts.get() if self.counts.exists() else (0, 0, 0)
        out = []
        for r in sorted(rows, key=lambda r: r.id):
            took = r.elapsed_ms
            seen = max(seen, r.ts)
            if r.kind == SPAWNED:
                spawned += 1
                if self.early.containsKey((spawned,)):
                    kind, waited = self.early.getValue((spawned,))
                    self.early.removeKey((spawned,))
                    out.append((spawned, r.ts, r.model, kind.removeprefix("worker_"), waited))
                else:
                    self.open.updateValue((spawned,), (r.ts, r.model, False))
                    self.handle.registerTimer(r.ts + self.stale_ms)
            else:
                ended += 1
                if self.open.containsKey((ended,)):
                    ts, model, _ = self.open.getValue((ended,))
                    self.open.removeKey((ended,))
                    out.append((ended, ts, model, r.kind.removeprefix("worker_"), took))
                else:
                    self.early.updateValue((ended,), (r.kind, took))
        self.counts.update((spawned, ended, seen))
        self.handle.registerTimer(seen + self.keep_ms)
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        for (n,), (ts, model, stale) in list(self.open.iterator()):
            if not stale and ts + self.stale_ms <= now:
                self.open.updateValue((n,), (ts, model, True))
                out.append((n, ts, model, "unknown-stale", None))
        if self.counts.exists() and self.counts.get()[2] + self.keep_ms <= now:
            for state in (self.counts, self.open, self.early):
                state.clear()
        yield from self._rows(key, out)

    def close(self) -> None:
        pass


def outcomes(events: DataFrame, late: str = "1 hour", stale_ms: int = 6 * HOUR_MS, keep_ms: int = 14 * 24 * HOUR_MS) -> DataFrame:
    """Rows of workers as they end or go stale, from a stream with fleet, session, id, ts, kind, model and elapsed_ms. The clock
    is the time of the workers' events, less `late`."""
    rows = events.where(F.col("kind").isin(SPAWNED, *ENDS)).select("fleet", "session", "id", "ts", "kind", "model", "elapsed_ms", F.timestamp_millis("ts").alias("at"))
    return rows.withWatermark("at", late).groupBy("fleet", "session").transformWithState(WorkerWatch(stale_ms, keep_ms), WorkerWatch.SCHEMA, "Append", "EventTime")


def latest_outcomes(rows: DataFrame) -> DataFrame:
    """Of each worker the row that counts: its end, if it came, else that it is stale."""
    from tracewell.operators.stores import latest

    return latest(rows, ["fleet", "session", "n"], F.col("outcome") == "unknown-stale")
