"""Streams of changes and calls, each with a batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.files import watch_class


def stamped(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Events with ``ts`` as a timestamp with time zone, which watermarks need."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def debounced(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id", value: str = "event_type") -> DataFrame:
    """(key, start, end, last, n): events of a key until it is silent for ``gap``; the last one counts. Batch or stream."""
    rows = stamped(events)
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    out = rows.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.max_by(value, F.struct("ts", "event_id")).alias("last"), F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "last", "n")


def rolling(events: DataFrame, seconds: int = 60, key: str = "user_id", value: str = "value") -> DataFrame:
    """Sum of ``value`` over the last ``seconds`` up to each event."""
    w = Window.partitionBy(key).orderBy(F.unix_seconds(F.col("ts").cast("timestamp"))).rangeBetween(-seconds, 0)
    return events.withColumn("rolling", F.sum(value).over(w))


def streaks(events: DataFrame, failed, key: str = "user_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Failures in a row up to each event; a success sets them to 0."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("failed", failed.cast("int")).withColumn("island", F.sum(1 - F.col("failed")).over(w))
    return rows.withColumn("streak", F.sum("failed").over(Window.partitionBy(key, "island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).drop("failed", "island")


def metrics(events: DataFrame, failed, limited, latency: str, used: str, window: str = "60 seconds", late: str = "2 minutes") -> DataFrame:
    """Successes, failures, rate limits, mean latency and tokens of each window of time."""
    rows = stamped(events)
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    ok = ~failed
    return rows.groupBy(F.window("ts", window).alias("w")).agg(
        F.count_if(ok).alias("successes"), F.count_if(failed).alias("failures"), F.count_if(limited).alias("limited"), F.avg(F.when(ok, F.col(latency))).alias("latency"), F.sum(used).alias("tokens")
    ).select(F.col("w.start").alias("start"), "successes", "failures", "limited", "latency", "tokens")


def routed(changes: DataFrame, known: DataFrame, auto_docs: bool = False) -> DataFrame:
    """Changes (file, event) with what is to be done: removed, notify (media, and documents unless ``auto_docs``), modified if the
    file is known (file), else added."""
    kind = watch_class(F.col("file"))
    old = known.select(F.col("file").alias("k")).distinct()
    route = F.when(F.col("event") == "unlink", "removed").when((kind == "media") | ((kind == "doc") & F.lit(not auto_docs)), "notify").when(F.col("k").isNotNull(), "modified").otherwise("added")
    return changes.join(old, F.col("file") == F.col("k"), "left").withColumn("route", route).drop("k")


def breaker(events: DataFrame, limit: int = 3, reset_seconds: int = 60) -> DataFrame:
    """(user_id, opened): times at which a key's circuit opens, after ``limit`` failures (value < 0 or type error) in a row; calls are
    refused until ``reset_seconds`` later, then counters start anew. A stateful operator on streams."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, pdfs, state):
        run, until = state.get if state.exists else (0, 0)
        out = []
        for pdf in pdfs:
            for r in pdf.sort_values(["at", "event_id"]).itertuples():
                if r.at < until:
                    continue
                if until:
                    run, until = 0, 0
                run = run + 1 if r.failed else 0
                if run >= limit:
                    until = int(r.at) + reset_seconds
                    out.append((key[0], int(r.at)))
        state.update((run, int(until)))
        yield pd.DataFrame(out, columns=["user_id", "opened"]).astype({"user_id": "int64", "opened": "int64"})

    rows = stamped(events).select("user_id", "event_id", F.unix_seconds("ts").alias("at"), (F.col("event_type") == "error").alias("failed"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, opened long", "run int, until long", "append", GroupStateTimeout.NoTimeout)


def file_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, event) between two scans (file, hash): add, change or unlink. A file source of a stream sees new files only; the
    others follow from a scan at each trigger."""
    b = after.select(F.col("file").alias("f"), F.col("hash").alias("h"))
    rows = before.join(b, F.col("file") == F.col("f"), "full_outer")
    event = F.when(F.col("file").isNull(), "add").when(F.col("f").isNull(), "unlink").when(~F.col("hash").eqNullSafe(F.col("h")), "change")
    return rows.select(F.coalesce("file", "f").alias("file"), event.alias("event")).filter("event IS NOT NULL")


def retried(call, attempts: int = 3, base: float = 1.0, factor: float = 2.0, most: float = 60.0, sleep=None):
    """``call`` tried up to ``attempts`` times, with a growing pause between; the last failure is raised. For clients inside tasks."""
    import time

    def again(*args, **kwargs):
        for n in range(1, attempts + 1):
            try:
                return call(*args, **kwargs)
            except Exception:
                if n == attempts:
                    raise
                (sleep or time.sleep)(min(most, base * factor ** (n - 1)))

    return again


def apply_changes(spark, changes: DataFrame, merge, checkpoint: str):
    """Start a stream that hands each batch of changes to ``merge(batch, id)`` once; state and progress live in ``checkpoint``."""
    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def incomplete(assigned: DataFrame, completed: DataFrame) -> DataFrame:
    """(worker, file) assigned but not completed."""
    return assigned.join(completed.select("worker", "file"), ["worker", "file"], "left_anti")
