"""The enhanced buy rule as windows over a symbol's bars, without a loop; see pullback.enhanced for the rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators import indicators as ind


def buys(bars: DataFrame) -> DataFrame:
    """(symbol, date, peak, low) of every bar that the buy rule marks; rows with a null price or volume are left out first.

    The newest peak far enough back stays the same from the second bar after it until the next one, so the lowest low since
    then is a running minimum over the bars that share it, of their own lows and those of the bars before them.
    """
    rows = ind.with_index(bars.dropna(subset=["high", "low", "close", "volume"]).select("symbol", "date", "high", "low", "close"))
    rows = rows.withColumns({"ma5": ind.exact_mean("close", 5, 2), "ma30": ind.exact_mean("close", 30, 2)})
    whole, cut, w = ind.by_date().rowsBetween(-2, 2), ind.by_date().rowsBetween(-2, 1), ind.by_date()
    k, high, low = F.col("bar_idx"), F.col("high"), F.col("low")
    tall = (k >= 33) & (high >= 1.2 * F.col("ma30"))
    rows = rows.withColumns({
        "slope": ind.slope("ma30", 5), "top": tall & (high == F.max("high").over(whole)), "near_top": tall & (high == F.max("high").over(cut)),
        "dip": low == F.min("low").over(whole), "near_dip": low == F.min("low").over(cut),
    })
    back = w.rowsBetween(Window.unboundedPreceding, -2)
    point = lambda price: F.struct(k.alias("k"), price.alias("x"))
    rows = rows.withColumns({
        "far": F.last(F.when(F.col("top"), point(high)), ignorenulls=True).over(back), "near": F.when(F.lag("near_top").over(w), F.lag(point(high)).over(w)),
        "low_far": F.last(F.when(F.col("dip"), point(low)), ignorenulls=True).over(back), "low_near": F.when(F.lag("near_dip").over(w), F.lag(point(low)).over(w)), "before": F.lag("low").over(w),
    })
    since = Window.partitionBy("symbol", F.col("far.k")).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"least": F.min(F.least("low", "before")).over(since), "peak": F.coalesce("near", "far"), "at": F.coalesce("low_near", "low_far")})
    ma5, ma30, close = F.col("ma5"), F.col("ma30"), F.col("close")
    bought = (k >= 78) & F.col("peak").isNotNull() & (F.col("slope") >= -1e-6) & (close > ma30) & (ma5 > ma30) & (ma30 > 1e-6) & ((close - ma30) / ma30 <= 0.05)
    recent = F.when(k - F.col("peak.k") < 5, F.col("before")).when(F.col("at.k") >= F.col("peak.k") + 5, F.col("at.x")).otherwise(F.col("least"))
    return rows.where(bought).select("symbol", "date", F.col("peak.x").alias("peak"), recent.alias("low"))
