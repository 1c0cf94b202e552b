"""Queries of streaming behaviour, run over the table as a batch (Q); tests compare them with streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.plans.catalog import query
from barloom.sources import read
from barloom.streaming import bars, state


def sql(unit: str) -> str:
    return f"SELECT event_type, date_trunc('{unit}', ts) AS start, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS n FROM events GROUP BY 1, 2"


@query("q01_event_bars_daily", sql("day"))
def q01(spark, d):
    return bars.event_bars(read(spark, d, "events"), "1 day")


@query("q01_event_bars_hourly", sql("hour"))
def q01h(spark, d):
    return bars.event_bars(read(spark, d, "events"), "1 hour")


EDGE = "TIMESTAMP '2024-01-20 00:00:00'"
BARS = "SELECT event_type, date_trunc('day', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM {t} GROUP BY 1, 2"


def _days(events):
    return events.groupBy("event_type", F.date_trunc("day", "ts").alias("start")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("q02_late_upsert", f"WITH early AS (SELECT * FROM events WHERE ts < {EDGE} AND event_id % 10 <> 0), late AS (SELECT * FROM events WHERE ts >= {EDGE} - INTERVAL 2 DAY) SELECT * FROM ({BARS.format(t='early')}) o WHERE start < {EDGE} - INTERVAL 2 DAY UNION ALL {BARS.format(t='late')}")
def q02(spark, d):
    """Days loaded early, without a tenth of the events that came late; the last two of them and what follows are made anew."""
    from barloom.operators.bars import upsert

    events = read(spark, d, "events")
    edge = F.lit("2024-01-20").cast("timestamp_ntz")
    first = _days(events.where((F.col("ts") < edge) & (F.col("event_id") % 10 != 0)))
    return upsert(first, _days(events.where(F.col("ts") >= edge - F.expr("interval 2 days"))), ["event_type", "start"])


@query("q02_unique_events", "SELECT event_id, event_type, value FROM events")
def q02b(spark, d):
    """Every event_id once, of events of which a third come twice."""
    events = read(spark, d, "events")
    return bars.unique_events(events.union(events.where("event_id % 3 = 0"))).select("event_id", "event_type", "value")


@query("q03_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def q03(spark, d):
    return bars.sessions(read(spark, d, "events")).select("user_id", "start", "n")


@query("q04_running_state", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS total FROM events")
def q04(spark, d):
    return bars.running_state(read(spark, d, "events")).select("event_id", F.round("total", 4).alias("total"))


WEEKS = "(PARTITION BY user_id, date_trunc('week', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"


@query("q04_settled_state", f"SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS total, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING), 6) AS mean, CAST(date_trunc('week', ts) AS DATE) AS week, first(value) OVER {WEEKS} AS open, max(value) OVER {WEEKS} AS high, min(value) OVER {WEEKS} AS low, count(*) OVER {WEEKS} AS n FROM events")
def q04_settled(spark, d):
    """Each event with its user's running total, the mean of the last five values and the bar of its week so far."""
    rows = state.settled(read(spark, d, "events"), width=5)
    return rows.select("event_id", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"), "week", "open", "high", "low", "n")
