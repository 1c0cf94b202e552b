import datetime as dt
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import pullback, strategies
from barloom.plans import fundamentals
from tests.test_operators import D, HEAD, drift, pullback_path, steep

SCHEMA = "symbol long, date date, open double, high double, low double, close double, volume double, amount double"


def daily(symbol, closes, end, volume=1000.0, step=1):
    """Bars up to a day; each close holds for ``step`` days."""
    start = end - dt.timedelta(days=len(closes) * step - 1)
    return [(symbol, start + dt.timedelta(days=i), c * 0.998, c * 1.004, c * 0.996, float(c), volume, volume * c) for i, c in enumerate(x for x in closes for _ in range(step))]


def table(spark, *rows):
    return reduce(DataFrame.union, [spark.createDataFrame(r, SCHEMA) for r in rows])


FRIDAY = D(2020, 5, 29)


def crossing():
    """Below all averages, then above them on double volume."""
    rows = daily(7, [10 + 0.01 * i for i in range(60)] + [10.2] * 3 + [11.5], FRIDAY)
    return rows[:-1] + [(*rows[-1][:6], 5000.0, 1.0)]


def bars(spark):
    weekly = [5 + 0.01 * i for i in range(140)] + drift(1.05, 4, 0.84, 3)[30:]
    return table(spark, daily(1, [8 + 0.01 * i for i in range(200)] + pullback_path(), FRIDAY), daily(2, weekly, FRIDAY, step=7), crossing(), daily(4, steep(0.8)[37:], FRIDAY, step=30), daily(9, [5.0] * 3, D(2019, 1, 1)))


def signals(frame):
    return sorted((r.symbol, r.strategy_name, r.signal_type, r.timeframe) for r in frame.collect())


def test_one_pass_equals_the_strategies_one_by_one(spark):
    given = strategies.frames(bars(spark), FRIDAY, 750, 3000)
    tagged = reduce(DataFrame.unionByName, [given[n].select(F.lit(n).alias("frame"), *pullback.PRICED) for n in ("daily", "weekly", "monthly")])
    alone = [s.run(given, FRIDAY) for s in strategies.SCREENED if s.name in pullback.PASSES]
    want = sorted(map(tuple, reduce(DataFrame.unionByName, alone).collect()))
    assert sorted(map(tuple, pullback.one_pass(tagged, {name: {} for name in pullback.PASSES}).collect())) == want
    assert {x[2] for x in want} >= {"AdaptedMAPullback"}


def test_report_has_the_screened_strategies(spark):
    rows, given = strategies.screened(bars(spark), FRIDAY)
    found = signals(rows)
    assert (1, "AdaptedMAPullback", "BUY", "Daily") in found and (7, "MultiLevelCross", "BUY", "Daily") in found
    assert all(s != 9 for s, *_ in found)  # no bar on the day
    names = spark.createDataFrame([(s, f"n{s}") for s in (1, 7)], "symbol long, stock_name string")
    empty = fundamentals.ops.analyse(rows, given["daily"], spark.createDataFrame([], "symbol long, report_type string, report_date date, data string"), spark.createDataFrame([], "symbol long, total_shares double"))
    shown = sorted((r.symbol, r.strategy_name, r.signal_level) for r in strategies.report(rows, names, empty).collect())
    assert shown == sorted((str(s), n, t) for s, n, _, t in found if s in (1, 7))


def test_a_failing_strategy_leaves_a_row(spark, monkeypatch):
    def broken(frames, **_):
        raise ValueError("bad bars")

    monkeypatch.setitem(pullback.PASSES, "ChanBreakout", ("Daily", broken))
    given = strategies.frames(bars(spark), FRIDAY)
    tagged = given["daily"].select(F.lit("daily").alias("frame"), *pullback.PRICED)
    got = {(r.symbol, r.signal_type, r.notes) for r in pullback.one_pass(tagged, {"ChanBreakout": {}}).collect()}
    assert got == {(s, "ERROR", "ValueError: bad bars") for s in (1, 2, 4, 7, 9)}


def executed(frame):
    """The plan that ran."""
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


def test_windows_on_laid_out_bars_need_no_exchange(spark):
    given = strategies.frames(bars(spark), FRIDAY)
    plan = executed(strategies.REGISTRY["BullishAlignment"].run(given, FRIDAY))
    assert "Exchange" not in plan and "Sort [" not in plan
    assert "Exchange" not in executed(given["weekly"].groupBy("symbol").count())


@pytest.mark.parametrize("name", ["n03_screener_report", "n02_signals_with_fundamentals"])
def test_the_report_reads_what_was_laid_out(spark, sf, name):
    plan = executed(fundamentals.screener_report(spark, sf)) if name.startswith("n03") else executed(fundamentals.n02(spark, sf))
    assert "lineitem.parquet" not in plan and "orders.parquet" not in plan  # read once, before
    assert len(HEAD) > 30
