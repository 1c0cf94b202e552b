import pytest
from pyspark.sql import functions as F

from barloom import functions as fn
from barloom.operators import pullback
from barloom.plans import sequences
from barloom.sources import walk_bars
from barloom.sources.tables import written

CASES = {
    "daily": (lambda b: pullback.pullback(b, pullback.DAILY, sequences._weeks(b)), lambda b, d: pullback.pullback_days(b, d, pullback.DAILY)),
    "breakout": (pullback.breakout, pullback.breakout_days),
    "weekly": (lambda b: pullback.pullback(sequences._weeks(b), pullback.WEEKLY, sequences._months(b)), lambda b, d: pullback.pullback_days(b, d, pullback.WEEKLY, fn.week_friday(F.col("date")))),
    "monthly": (lambda b: pullback.pullback(sequences._months(b), pullback.MONTHLY), lambda b, d: pullback.pullback_days(b, d, pullback.MONTHLY, fn.business_month_end(F.col("date")))),
}


@pytest.mark.parametrize("name", CASES)
def test_days_that_are_left_out_have_no_signal(spark, sf, name):
    run, wanted = CASES[name]
    bars = written(walk_bars(spark, sf), "walk")
    pairs = lambda rows: {tuple(r) for r in rows.select("symbol", "n").collect()}
    days = spark.createDataFrame(list(enumerate(sequences.DAYS)), "n int, to string").withColumn("to", F.col("to").cast("date"))
    all_ = bars.select("symbol").distinct().crossJoin(days)
    signals = run(written(sequences.over_days(bars, all_), "histories")).where("signal_type = 'BUY'")
    found = pairs(signals.select(F.floor(F.col("symbol") / 100).alias("symbol"), (F.col("symbol") % 100).alias("n")))
    kept = pairs(wanted(bars, sequences.DAYS))
    assert found <= kept and len(kept) < 0.4 * all_.count()
