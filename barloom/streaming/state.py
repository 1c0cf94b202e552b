"""State that a key carries from event to event, in the order of event time whatever the order of arrival.

In a stream each key keeps the events that later ones may still precede.  Once the watermark has passed them, an event-time
timer settles them in the order of (ts, event_id): each gets the running total, the mean of the last values and the bar of its
week so far, and only the total, the last values and that bar stay.  So what comes out equals windows over the whole table for
every event that came within the watermark's delay; Spark drops later ones.
"""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTLED = "user_id long, event_id long, ts timestamp, total double, mean double, week date, open double, high double, low double, n long"
WAITING = "ts timestamp, event_id long, value double"
CARRIED = "at timestamp, total double, last array<double>, week date, open double, high double, low double, n long"


class _Carried:
    """What a key carries; add() takes the next event in order."""

    NOTHING = (None, 0.0, [], None, None, None, None, 0)

    def __init__(self, row, width: int, idle_ms: int | None):
        self.width, self.idle = width, idle_ms
        self._set(row or self.NOTHING)

    def _set(self, row) -> None:
        self.at, self.total, self.last, self.week, self.open, self.high, self.low, self.n = row

    def row(self):
        return self.at, self.total, list(self.last), self.week, self.open, self.high, self.low, self.n

    def add(self, ts, value):
        """(total, mean, week, open, high, low, n) after the event; a missing value counts in n and in nothing else."""
        if self.idle is not None and self.at is not None and _ms(ts) - _ms(self.at) > self.idle:
            self._set(self.NOTHING)
        self.at = ts
        value = None if value is None or pd.isna(value) else float(value)
        week = ts.date() - dt.timedelta(days=ts.weekday())
        if week != self.week:
            self.week, self.open, self.high, self.low, self.n = week, None, None, None, 0
        self.n += 1
        self.last = [*self.last, value][-self.width :]
        if value is not None:
            self.total += value
            self.open = value if self.open is None else self.open
            self.high = value if self.high is None else max(self.high, value)
            self.low = value if self.low is None else min(self.low, value)
        known = [x for x in self.last if x is not None]
        return self.total, sum(known) / len(known) if known else None, self.week, self.open, self.high, self.low, self.n


class Settle(StatefulProcessor):
    """One key's events; ``width``: rows of the mean; ``idle_ms``: an event later than that after the one before begins anew,
    so what a key carries goes once the watermark has passed so long after its last event."""

    def __init__(self, width: int, idle_ms: int | None = None):
        self.width, self.idle = width, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.carried = handle.getValueState("carried", CARRIED)
        self.newest = handle.getValueState("newest", "at long")

    def _timer(self, ms: int) -> None:
        self.handle.registerTimer(ms)

    def handleInputRows(self, key, rows, timerValues):
        new = [(r.ts.to_pydatetime(), int(r.event_id), None if pd.isna(r.value) else float(r.value)) for part in rows for r in part.itertuples(index=False)]
        if not new:
            return
        self.waiting.appendList(new)
        self._timer(_ms(min(ts for ts, _, _ in new)))
        last = max(_ms(ts) for ts, _, _ in new)
        if not self.newest.exists() or self.newest.get()[0] < last:
            self.newest.update((last,))
            if self.idle is not None:
                self._timer(last + self.idle + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        edge = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(r) for r in self.waiting.get())
        ready = [r for r in held if _ms(r[0]) < edge]
        if ready:
            now = _Carried(self.carried.get() if self.carried.exists() else None, self.width, self.idle)
            out = [(key[0], event_id, ts, *now.add(ts, value)) for ts, event_id, value in ready]
            self.carried.update(now.row())
            rest = held[len(ready) :]
            if rest:
                self.waiting.put(rest)
                self._timer(_ms(rest[0][0]))
            else:
                self.waiting.clear()
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SETTLED.split(", ")])
        if self.idle is not None and not held[len(ready) :] and self.newest.exists() and self.newest.get()[0] + self.idle < edge:
            self.carried.clear()
            self.newest.clear()

    def close(self) -> None:
        pass


def _ms(ts: dt.datetime) -> int:
    """Milliseconds since 1970, rounded down; state holds times without a zone in UTC."""
    return (ts.replace(tzinfo=None) - dt.datetime(1970, 1, 1)) // dt.timedelta(milliseconds=1)


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state of this kind needs the RocksDB store; the session's timers and times have to be in UTC."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def settled(events: DataFrame, late: str = "2 days", width: int = 5, idle_ms: int | None = None) -> DataFrame:
    """SETTLED rows of every event (user_id, event_id, ts, value): see the module; over a table the same by windows.

    Rows without a time take no part, those without a user are one group; a missing value counts in n only.  ``mean`` is of the
    known ones among the last ``width`` values; weeks begin on Monday.
    """
    rows = events.where("ts is not null").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    if events.isStreaming:
        use_rocksdb(events.sparkSession)
        return rows.withWatermark("ts", late).groupBy("user_id").transformWithStateInPandas(Settle(width, idle_ms), SETTLED, "append", "eventTime")
    rows = rows.withColumns({"week": F.date_trunc("week", "ts").cast("date"), "turn": F.lit(0)})
    if idle_ms is not None:
        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        gap = F.unix_millis("ts") - F.unix_millis(F.lag("ts").over(w)) > idle_ms
        rows = rows.withColumn("new", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("turn", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    every = Window.partitionBy("user_id", "turn").orderBy("ts", "event_id")
    so_far = every.rowsBetween(Window.unboundedPreceding, 0)
    in_week = Window.partitionBy("user_id", "turn", "week").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        "user_id", "event_id", "ts", F.sum(F.coalesce("value", F.lit(0.0))).over(so_far).alias("total"), F.avg("value").over(every.rowsBetween(1 - width, 0)).alias("mean"), "week",
        F.first("value", ignorenulls=True).over(in_week).alias("open"), F.max("value").over(in_week).alias("high"), F.min("value").over(in_week).alias("low"), F.count("*").over(in_week).alias("n"),
    )
