import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import fundamentals as ops
from barloom.operators import pullback, strategies
from barloom.plans import fundamentals
from barloom.sources import daily_bars, last_day, reports, walk_bars
from tests.test_screener import FRIDAY, bars, executed


def test_only_symbols_with_a_bar_of_the_day_are_passed_on(spark):
    given = strategies.frames(bars(spark), FRIDAY)
    kept = {r.symbol for r in strategies.ending_from(given["daily"], F.lit(FRIDAY)).select("symbol").distinct().collect()}
    assert kept == {1, 2, 4, 7} and 9 in {r.symbol for r in given["daily"].select("symbol").distinct().collect()}


def test_signals_of_a_day_are_those_of_all_symbols(spark, sf):
    """Days of every kind: inside weeks, Fridays, weekends, ends of months."""
    walk = walk_bars(spark, sf)
    for day in ("1998-03-11", "1998-05-29", "1998-08-15", "1998-11-30"):
        day = dt.date.fromisoformat(day)
        given = strategies.frames(walk, day)
        every = reduce(DataFrame.unionByName, [given[n].select(F.lit(n).alias("frame"), *pullback.PRICED) for n in ("daily", "weekly", "monthly")])
        some = reduce(DataFrame.unionByName, [strategies.ending_from(given[n], F.lit(day)).select(F.lit(n).alias("frame"), *pullback.PRICED) for n in ("daily", "weekly", "monthly")])
        found = [sorted(map(str, pullback.one_pass(x, {name: {} for name in pullback.PASSES}).where(F.col("signal_date") == F.lit(day)).collect())) for x in (every, some)]
        assert found[0] == found[1]
        assert some.count() < every.count()


def test_the_last_day_comes_from_the_trades(spark, sf):
    assert last_day(spark, sf) == daily_bars(spark, sf).agg(F.max("date")).first()[0]


def test_metrics_of_crosses_read_trades_and_orders_once(spark, sf):
    got = fundamentals.metrics(spark, sf)
    plan = executed(got).split("Initial Plan")[0]
    assert plan.count("lineitem.parquet") == 1 and "orders.parquet" not in plan
    want = ops.analyse(fundamentals.signals(spark, sf), daily_bars(spark, sf), reports(spark, sf), fundamentals.shares(spark, sf))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
