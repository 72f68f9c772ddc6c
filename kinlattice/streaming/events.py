"""Event streams: duplicates within a time, rolling counters, digests, and jobs that end.

The same functions take batch tables; ``*_batch`` ones state the exact stored-row rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Fixed states after which a job says nothing more.
TERMINAL = ("succeeded", "failed", "canceled")


def first_within(events: DataFrame, keys: list[str], ts: str, minutes: int) -> DataFrame:
    """A stream without repeats of a key within ``minutes``; state is dropped as the watermark passes."""
    return events.withWatermark(ts, f"{minutes} minutes").dropDuplicatesWithinWatermark(keys)


def first_within_batch(events: DataFrame, keys: list[str], ts: str, order: str, minutes: int) -> DataFrame:
    """Rows kept when a repeat within ``minutes`` of the last kept row is refused (a refused row extends nothing).

    The kept rows of a key are a chain, folded over its rows in order: one key's rows meet in one task.
    """
    rows = events.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(ts, order))).alias("r"))
    gap = F.expr(f"INTERVAL {minutes} MINUTES")
    kept = F.aggregate(
        "r",
        F.struct(F.lit(None).cast(events.schema[ts].dataType).alias("last"), F.array().cast(f"array<{dict(events.dtypes)[order]}>").alias("ids")),
        lambda a, x: F.when(a["last"].isNull() | (x[ts] >= a["last"] + gap), F.struct(x[ts].alias("last"), F.concat(a["ids"], F.array(x[order])).alias("ids"))).otherwise(a),
    )
    return rows.select(*keys, F.explode(kept["ids"]).alias(order))


def daily(events: DataFrame, keys: list[str], ts: str, late: str = "1 day") -> DataFrame:
    """(keys, day, n): counters of whole days, late rows accepted for ``late``."""
    stream = events.withWatermark(ts, late) if events.isStreaming else events
    return stream.groupBy(*keys, F.window(ts, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("day"), "n")


def weekly(events: DataFrame, keys: list[str], ts: str, late: str = "1 day") -> DataFrame:
    """(keys, week, n) of weeks that begin on Mondays."""
    stream = events.withWatermark(ts, late) if events.isStreaming else events
    return stream.groupBy(*keys, F.window(ts, "7 days", "7 days", "4 days").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("week"), "n")


def until_terminal(events: DataFrame, key: str, ts: str, order: str, stage: str) -> DataFrame:
    """Rows of each job up to its first terminal stage, for stored events."""
    w = Window.partitionBy(key).orderBy(ts, order).rowsBetween(Window.unboundedPreceding, -1)
    over = F.max(F.col(stage).isin(*TERMINAL).cast("int")).over(w)
    return events.withColumn("_over", F.coalesce(over, F.lit(0))).where("_over = 0").drop("_over")


def watch_jobs(events: DataFrame, key: str, ts: str, stage: str, idle: str = "1 hour") -> DataFrame:
    """(key, stages, ended) of a stream of job events: one row when a job ends or has been idle for long."""
    from ..storage import ship

    ship(events.sparkSession)
    kind = dict(events.dtypes)[key]
    millis = {"hour": 3_600_000, "minute": 60_000, "second": 1000}
    number, unit = idle.split()
    wait = int(number) * millis[unit.rstrip("s")]

    def run(job, batches, state):
        import pandas as pd

        seen = state.get[0] if state.exists else 0
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"job": [job[0]], "stages": [seen], "ended": [False]})
            return
        done = False
        for rows in batches:
            for s in rows.sort_values(ts)[stage]:
                if not done:
                    seen += 1
                    done = s in TERMINAL
        if done:
            state.remove()
            yield pd.DataFrame({"job": [job[0]], "stages": [seen], "ended": [True]})
        else:
            state.update((seen,))
            state.setTimeoutDuration(wait)

    return events.groupBy(key).applyInPandasWithState(run, f"job {kind}, stages int, ended boolean", "seen int", "append", "ProcessingTimeTimeout")


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """A query that writes Parquet and stops when what there is has been read."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class ProgressLog(StreamingQueryListener):
    """Progress of streaming queries as (query, stage, rows), fire and forget: nothing waits for a reader."""

    def __init__(self, publish):
        self.publish = publish

    def onQueryStarted(self, event):
        self.publish((str(event.id), "started", 0))

    def onQueryProgress(self, event):
        self.publish((str(event.progress.id), "running", event.progress.numInputRows))

    def onQueryIdle(self, event):
        self.publish((str(event.id), "idle", 0))

    def onQueryTerminated(self, event):
        self.publish((str(event.id), "failed" if event.exception else "succeeded", 0))
