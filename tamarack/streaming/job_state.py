"""Jobs as state of a stream: the log of their events in, every change of a job out, and a timer a
job that fails it when nothing happens for too long."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.jobs import TIMED_OUT

COUNTS = ["total_items", "processed_items", "success_items", "failed_items"]
OVER = ("completed", "failed", "cancelled")
STATE = "status string, changed_ms long, total_items long, processed_items long, success_items long, failed_items long, error_message string"
CHANGE = "job_id string, at timestamp, status string, total_items long, processed_items long, success_items long, failed_items long, error_message string"


def _number(v: Any) -> int | None:
    return None if pd.isna(v) else int(v)


class JobState(StatefulProcessor):
    """Folds a job's events in order of time within a batch. A job that is over stays as it is; one
    whose next event, or the watermark, lies more than ``seconds`` after its last one has failed then."""

    def __init__(self, seconds: int = 300):
        self.wait = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)

    def _out(self, key, held: list) -> pd.DataFrame:
        status, ms, *counts, error = held
        at = pd.Timestamp(ms, unit="ms", tz="UTC").tz_convert(None)
        return pd.DataFrame({"job_id": [key[0]], "at": [at], "status": [status], **{c: pd.array([v], "Int64") for c, v in zip(COUNTS, counts, strict=True)}, "error_message": [error]})

    def _fail(self, held: list) -> list:
        return ["failed", held[1] + self.wait, *held[2:6], TIMED_OUT]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.job.get()) if self.job.exists() else None
        events = pd.concat(list(rows), ignore_index=True)
        out = []
        for e in events.sort_values(["at", "processed_items"], na_position="first", kind="stable").itertuples(index=False):
            if held and held[0] in OVER:
                break
            ms = int(pd.Timestamp(e.at).value // 1_000_000)
            if held and ms - held[1] > self.wait:
                held = self._fail(held)
            elif held is None or ms >= held[1]:
                before = held or [None] * 7
                held = [e.status, ms, *[n if (n := _number(getattr(e, c))) is not None else before[2 + i] for i, c in enumerate(COUNTS)], e.error_message if isinstance(e.error_message, str) else before[6]]
            else:
                continue  # older than what the job has come to
            out.append(self._out(key, held))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if held and held[0] not in OVER:
            self.handle.registerTimer(held[1] + self.wait)
        self.job.update(tuple(held))
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = list(self.job.get())
        if held[0] not in OVER:
            held = self._fail(held)
            self.job.update(tuple(held))
            yield self._out(key, held)

    def close(self) -> None:
        pass


def job_changes(events: DataFrame, seconds: int = 300, late: str = "0 seconds") -> DataFrame:
    """Every change of a job, of a stream of events (job_id, at, status, counts, error_message). The
    session has to keep state in RocksDB (``STORE``)."""
    kept = events.select("job_id", "at", "status", *COUNTS, "error_message").withWatermark("at", late)
    return kept.groupBy("job_id").transformWithStateInPandas(JobState(seconds), CHANGE, outputMode="Append", timeMode="EventTime")


#: The state store that timers need.
STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
