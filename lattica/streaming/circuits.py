"""Circuit breakers on a stream, with timers: a key's circuit opens after failures in a row and closes by itself."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .events import stamped

OUT = "user_id long, change string, at long"


class Breaker(StatefulProcessor):
    """State of a key: failures in a row so far, and until when its circuit is open. A key with neither has no state, so that the state is as large as
    the number of keys that fail just now."""

    def __init__(self, limit: int, reset: int):
        self.limit, self.reset = limit, reset

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "run int, until long")

    def handleInputRows(self, key, rows, timerValues):
        import numpy as np
        import pandas as pd

        pdf = pd.concat(list(rows)).sort_values(["at", "event_id"])
        at, failed = pdf["at"].to_numpy(), pdf["failed"].to_numpy(bool)
        run, until = self.state.get() if self.state.exists() else (0, 0)
        was, out, i = until, [], 0
        while True:
            if until:  # calls are refused while it is open
                i = max(i, int(np.searchsorted(at, until)))
                if i == len(at):
                    break
                out.append((key[0], "closed", until))
                run, until = 0, 0
            place = np.arange(len(at) - i)
            good = np.maximum.accumulate(np.where(failed[i:], -1, place)) if len(place) else place
            streak = np.where(good < 0, place + 1 + run, place - good)
            over = np.flatnonzero(streak >= self.limit)
            if not len(over):
                run = int(streak[-1]) if len(streak) else run
                break
            i += int(over[0])
            until = int(at[i]) + self.reset
            out.append((key[0], "opened", int(at[i])))
            i += 1
        if until != was:
            if was:
                self.handle.deleteTimer(was * 1000)
            if until:
                self.handle.registerTimer(until * 1000)
        self._keep(run if not until else 0, until)
        yield pd.DataFrame(out, columns=["user_id", "change", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        self._keep(0, 0)
        yield pd.DataFrame([(key[0], "closed", expiredTimerInfo.getExpiryTimeInMs() // 1000)], columns=["user_id", "change", "at"])

    def _keep(self, run: int, until: int) -> None:
        if run or until:
            self.state.update((run, until))
        elif self.state.exists():
            self.state.clear()

    def close(self) -> None:
        pass


def circuits(events: DataFrame, limit: int = 3, reset_seconds: int = 60, late: str = "10 seconds") -> DataFrame:
    """(user_id, change, at): when each key's circuit opens, after ``limit`` failures (type error) in a row, and closes again, ``reset_seconds`` later, when
    event time (less ``late``) has passed it or a later call of the key comes; calls are refused in between, and counters start anew. Rows of a key are taken in order of time within a
    batch. For streams; the state store must hold timers (``timed_state``)."""
    rows = stamped(events).withWatermark("ts", late)
    rows = rows.select("user_id", "event_id", "ts", F.unix_seconds("ts").alias("at"), (F.col("event_type") == "error").alias("failed"))
    return rows.groupBy("user_id").transformWithStateInPandas(Breaker(limit, reset_seconds), OUT, "Append", "EventTime")


@contextmanager
def timed_state(spark: SparkSession):
    """Streams started inside keep their state where timers are possible; the session's setting is put back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)
