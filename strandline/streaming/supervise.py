"""Live counters of running streams, and an end in good order: at a deadline the batch at work is finished, not cut off."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

COMPLETE, DRAINED, TIMED_OUT, FAILED = "COMPLETE", "DRAINED", "TIMED_OUT", "FAILED"


@dataclass
class Counts:
    """What one run has committed so far."""

    batches: int = 0
    rows: int = 0
    most_rows: int = 0  # of one batch
    failure: str | None = None
    ended: threading.Event = field(default_factory=threading.Event)


class Counters(StreamingQueryListener):
    """Counts by run, from the engine's own progress reports; a report is sent after its batch is committed."""

    def __init__(self):
        self.runs: dict[str, Counts] = {}

    def of(self, run: object) -> Counts:
        return self.runs.setdefault(str(run), Counts())

    def onQueryStarted(self, event):
        self.of(event.runId)

    def onQueryProgress(self, event):
        c, n = self.of(event.progress.runId), event.progress.numInputRows
        if n:
            c.batches, c.rows, c.most_rows = c.batches + 1, c.rows + n, max(c.most_rows, n)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        c = self.of(event.runId)
        c.failure = event.exception
        c.ended.set()


@dataclass(frozen=True)
class Outcome:
    state: str
    batches: int
    rows: int
    most_rows: int
    failure: str | None


def at_rest(query: StreamingQuery, until: float) -> bool:
    """Wait until no batch is at work; False if one still is at the time `until` (of time.monotonic)."""
    while query.isActive and query.status["isTriggerActive"]:
        if time.monotonic() >= until:
            return False
        time.sleep(0.02)
    return True


def supervised(spark: SparkSession, start: Callable[[], StreamingQuery], seconds: float | None = None, drain_seconds: float = 60.0) -> Outcome:
    """Run a stream until it ends or for some seconds, and say how it ended.

    COMPLETE: it ended by itself. DRAINED: at the deadline the batch at work was finished within `drain_seconds`. TIMED_OUT:
    it was not, and was given up; its checkpoint has the batch as not done, and the next start repeats it. FAILED: a batch or
    the source raised; `failure` has the message.
    """
    counters = Counters()
    spark.streams.addListener(counters)
    try:
        query = start()
        counts, state = counters.of(query.runId), COMPLETE
        try:
            ended = query.awaitTermination(seconds) if seconds is not None else query.awaitTermination() or True
        except Exception as error:  # noqa: BLE001 - whatever ended the stream is what is reported
            ended, state, counts.failure = True, FAILED, str(error)
        if not ended:
            state = DRAINED if at_rest(query, time.monotonic() + drain_seconds) else TIMED_OUT
            query.stop()
        counts.ended.wait(30)
        if state == COMPLETE and counts.failure:
            state = FAILED
        return Outcome(state, counts.batches, counts.rows, counts.most_rows, counts.failure)
    finally:
        spark.streams.removeListener(counters)
