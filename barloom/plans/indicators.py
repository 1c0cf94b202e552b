"""Queries of windows and indicators (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom import functions as fn
from barloom.operators import indicators as ind
from barloom.operators.scans import indicators as folds
from barloom.plans.catalog import query
from barloom.sources import daily_bars, dealt_bars

W = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
O = "OVER (PARTITION BY symbol ORDER BY date)"  # noqa: E741


def w(n: int) -> str:
    return W.format(n - 1)


def r(c, places: int = 6):
    return fn.signed_round(F.col(c) if isinstance(c, str) else c, places)


@query("f01_sma_partial", f"SELECT symbol, date, round(avg(close) {w(30)}, 6) AS ma30 FROM bars", "bars")
def f01(spark, d):
    return daily_bars(spark, d).select("symbol", "date", r(ind.mean("close", 30)).alias("ma30"))


@query("f02_sma_full", f"SELECT symbol, date, CASE WHEN count(close) {w(20)} = 20 THEN round(avg(close) {w(20)}, 2) END AS ma20 FROM bars", "bars")
def f02(spark, d):
    return daily_bars(spark, d).select("symbol", "date", ind.mean("close", 20, True, 2).alias("ma20"))


@query("f03_volume_mean", f"SELECT symbol, date, round(avg(volume) {w(60)}, 6) AS vma60 FROM bars", "bars")
def f03(spark, d):
    return daily_bars(spark, d).select("symbol", "date", r(ind.mean("volume", 60)).alias("vma60"))


@query("f04_lag_compare", f"SELECT symbol, date, round(lag(close) {O}, 6) AS pclose, close > lag(close) {O} AS up, volume > lag(volume) {O} AS more FROM bars", "bars")
def f04(spark, d):
    return daily_bars(spark, d).select("symbol", "date", r(ind.lag("close")).alias("pclose"), (F.col("close") > ind.lag("close")).alias("up"), (F.col("volume") > ind.lag("volume")).alias("more"))


@query("f15_centred_extrema", "SELECT symbol, date, round(high, 6) = round(max(high) OVER c, 6) AS is_top, round(low, 6) = round(min(low) OVER c, 6) AS is_bottom FROM bars WINDOW c AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)", "bars")
def f15(spark, d):
    c = ind.by_date().rowsBetween(-2, 2)
    return daily_bars(spark, d).select("symbol", "date", (r("high") == r(F.max("high").over(c))).alias("is_top"), (r("low") == r(F.min("low").over(c))).alias("is_bottom"))


@query("f16_ma_slope", f"WITH i AS (SELECT *, row_number() {O} - 1 AS bar_idx FROM bars), m AS (SELECT symbol, date, bar_idx, CASE WHEN count(close) {w(30)} = 30 THEN round(avg(close) {w(30)}, 2) END AS ma FROM i) SELECT symbol, date, CASE WHEN count(ma) {w(4)} = 4 THEN round(regr_slope(ma, bar_idx) {w(4)}, 4) + 0.0 END AS slope FROM m", "bars")
def f16(spark, d):
    rows = ind.with_index(daily_bars(spark, d)).withColumn("ma", ind.mean("close", 30, True, 2))
    return rows.select("symbol", "date", (r(ind.slope("ma", 4), 4) + F.lit(0.0)).alias("slope"))


@query("f17_gain_ratio", f"SELECT symbol, date, round(max(high) {w(30)} / min(low) {w(30)}, 6) AS gain FROM bars", "bars")
def f17(spark, d):
    return daily_bars(spark, d).select("symbol", "date", r(F.try_divide(F.max("high").over(ind.over(30)), F.min("low").over(ind.over(30)))).alias("gain"))


@query("f18_below_run", f"WITH m AS (SELECT symbol, date, round(close, 6) AS close, round(avg(close) {w(30)}, 6) AS ma FROM bars) SELECT symbol, date, sum(CASE WHEN close < ma THEN 1 ELSE 0 END) {w(3)} = 3 AS run FROM m", "bars")
def f18(spark, d):
    rows = daily_bars(spark, d).select("symbol", "date", r("close").alias("close"), r(ind.mean("close", 30)).alias("ma"))
    return rows.select("symbol", "date", ind.below_run("close", "ma").alias("run"))


@query("f19_later_breach", f"WITH m AS (SELECT symbol, date, round(close, 6) AS close, round(avg(close) {w(30)} * 0.97, 6) AS floor FROM bars) SELECT symbol, date, coalesce(max(CASE WHEN close < floor THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) = 1 AS broken FROM m", "bars")
def f19(spark, d):
    rows = daily_bars(spark, d).select("symbol", "date", r("close").alias("close"), r(ind.mean("close", 30) * 0.97).alias("floor"))
    later = ind.by_date().rowsBetween(1, 2**31 - 1)
    return rows.select("symbol", "date", (F.coalesce(F.max(F.when(F.col("close") < F.col("floor"), 1).otherwise(0)).over(later), F.lit(0)) == 1).alias("broken"))


@query("f20_returns", f"SELECT symbol, date, round(close / lag(close) {O} - 1, 6) AS ret FROM bars", "bars")
def f20(spark, d):
    return daily_bars(spark, d).select("symbol", "date", r(F.try_divide(F.col("close"), ind.lag("close")) - 1).alias("ret"))


@query("f21_range_low", "SELECT symbol, date, round(min(low) OVER (PARTITION BY symbol ORDER BY date RANGE BETWEEN INTERVAL 750 DAY PRECEDING AND CURRENT ROW), 6) AS low750 FROM bars", "bars")
def f21(spark, d):
    from pyspark.sql import Window

    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    span = Window.partitionBy("symbol").orderBy(day).rangeBetween(-750, 0)
    return daily_bars(spark, d).select("symbol", "date", r(F.min("low").over(span)).alias("low750"))


EMA_SQL = """
WITH RECURSIVE i AS (SELECT symbol, date, close, high, low, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS k FROM bars), e AS (
  SELECT symbol, date, k, close, close AS e12, close AS e26, 0.0::DOUBLE AS dea, NULL::DOUBLE AS up, NULL::DOUBLE AS down FROM i WHERE k = 0
  UNION ALL
  SELECT i.symbol, i.date, i.k, i.close, e.e12 * 11 / 13 + i.close * 2 / 13, e.e26 * 25 / 27 + i.close * 2 / 27,
    e.dea * 0.8 + 0.2 * ((e.e12 * 11 / 13 + i.close * 2 / 13) - (e.e26 * 25 / 27 + i.close * 2 / 27)),
    CASE WHEN e.up IS NULL THEN greatest(i.close - e.close, 0) ELSE e.up * 13 / 14 + greatest(i.close - e.close, 0) / 14 END,
    CASE WHEN e.down IS NULL THEN greatest(e.close - i.close, 0) ELSE e.down * 13 / 14 + greatest(e.close - i.close, 0) / 14 END
  FROM e JOIN i ON i.symbol = e.symbol AND i.k = e.k + 1
)"""


@query("f08_ema", EMA_SQL + "SELECT symbol, date, round(e12, 4) AS ema12, round(e26, 4) AS ema26 FROM e", "bars")
def f08(spark, d):
    return folds(dealt_bars(spark, d), ["ema12", "ema26"]).select("symbol", "date", r("ema12", 4).alias("ema12"), r("ema26", 4).alias("ema26"))


@query("f09_macd", EMA_SQL + "SELECT symbol, date, round(e12 - e26, 4) AS diff, round(dea, 4) AS dea, round(2 * (e12 - e26 - dea), 4) AS bar FROM e", "bars")
def f09(spark, d):
    return folds(dealt_bars(spark, d), ["diff", "dea", "bar"]).select("symbol", "date", r("diff", 4).alias("diff"), r("dea", 4).alias("dea"), r("bar", 4).alias("bar"))


@query("f07_rsi", EMA_SQL + "SELECT symbol, date, CASE WHEN down > 0 THEN round(100 - 100 / (1 + up / down), 4) WHEN up > 0 THEN 100 END AS rsi FROM e", "bars")
def f07(spark, d):
    return folds(dealt_bars(spark, d), ["rsi"]).select("symbol", "date", r("rsi", 4).alias("rsi"))


SEEDED_SQL = """
WITH RECURSIVE i AS (SELECT symbol, date, close, high, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS k FROM bars),
fast AS (
  SELECT symbol, 25::BIGINT AS k, avg(close) AS y FROM i WHERE k BETWEEN 14 AND 25 GROUP BY symbol HAVING count(*) = 12
  UNION ALL SELECT i.symbol, i.k, f.y + (i.close - f.y) * 2 / 13 FROM fast f JOIN i ON i.symbol = f.symbol AND i.k = f.k + 1
), slow AS (
  SELECT symbol, 25::BIGINT AS k, avg(close) AS y FROM i WHERE k BETWEEN 0 AND 25 GROUP BY symbol HAVING count(*) = 26
  UNION ALL SELECT i.symbol, i.k, s.y + (i.close - s.y) * 2 / 27 FROM slow s JOIN i ON i.symbol = s.symbol AND i.k = s.k + 1
), line AS (SELECT symbol, k, fast.y - slow.y AS v FROM fast JOIN slow USING (symbol, k)), sig AS (
  SELECT symbol, 33::BIGINT AS k, avg(v) AS y FROM line WHERE k BETWEEN 25 AND 33 GROUP BY symbol HAVING count(*) = 9
  UNION ALL SELECT l.symbol, l.k, s.y + (l.v - s.y) * 2 / 10 FROM sig s JOIN line l ON l.symbol = s.symbol AND l.k = s.k + 1
), macd AS (SELECT i.symbol, i.date, i.high, round(line.v, 4) AS macd, round(sig.y, 4) AS macd_signal, round(line.v - sig.y, 4) AS macd_hist FROM i LEFT JOIN sig ON sig.symbol = i.symbol AND sig.k = i.k LEFT JOIN line ON line.symbol = i.symbol AND line.k = i.k AND i.k >= 33)
"""


@query("f10_macd_seeded", SEEDED_SQL + "SELECT symbol, date, macd, macd_signal, macd_hist FROM macd", "bars")
def f10(spark, d):
    return folds(dealt_bars(spark, d), ["macd", "macd_signal", "macd_hist"]).select("symbol", "date", r("macd", 4).alias("macd"), r("macd_signal", 4).alias("macd_signal"), r("macd_hist", 4).alias("macd_hist"))


@query("f11_atr", """
WITH RECURSIVE i AS (SELECT symbol, date, greatest(high - low, abs(high - lag(close) OVER o), abs(low - lag(close) OVER o)) AS tr, row_number() OVER o - 1 AS k FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY date)), e AS (
  SELECT i.symbol, i.k, (SELECT avg(tr) FROM i j WHERE j.symbol = i.symbol AND j.k BETWEEN 1 AND 14) AS atr FROM i WHERE i.k = 14
  UNION ALL SELECT i.symbol, i.k, (e.atr * 13 + i.tr) / 14 FROM e JOIN i ON i.symbol = e.symbol AND i.k = e.k + 1
) SELECT i.symbol, i.date, round(e.atr, 4) AS atr FROM i LEFT JOIN e ON e.symbol = i.symbol AND e.k = i.k""", "bars")
def f11(spark, d):
    return folds(dealt_bars(spark, d), ["atr"]).select("symbol", "date", r("atr", 4).alias("atr"))


ADX_SQL = f"""
WITH RECURSIVE i AS (SELECT symbol, date, greatest(high - lag(high) {O}, 0) AS up, greatest(lag(low) {O} - low, 0) AS down, greatest(high - low, abs(high - lag(close) {O}), abs(low - lag(close) {O})) AS tr, row_number() {O} - 1 AS k FROM bars), r AS (SELECT symbol, k, CASE WHEN count(tr) {w(14)} = 14 THEN avg(tr) {w(14)} END AS base FROM i), e AS (
  SELECT symbol, k, up AS un, down AS dn, 1.0::DOUBLE AS wt FROM i WHERE k = 1
  UNION ALL SELECT i.symbol, i.k, i.up + e.un * 13 / 14, i.down + e.dn * 13 / 14, 1 + e.wt * 13 / 14 FROM e JOIN i ON i.symbol = e.symbol AND i.k = e.k + 1
), t AS (SELECT i.symbol, i.date, e.un / e.wt AS up, e.dn / e.wt AS down, r.base FROM i JOIN r ON r.symbol = i.symbol AND r.k = i.k LEFT JOIN e ON e.symbol = i.symbol AND e.k = i.k),
x AS (SELECT symbol, date, CASE WHEN up / base + down / base <> 0 THEN 100 * abs(up / base - down / base) / (up / base + down / base) END AS dx FROM t),
adx AS (SELECT symbol, date, CASE WHEN count(dx) {w(14)} = 14 THEN round(avg(dx) {w(14)}, 4) END AS adx FROM x)
"""


@query("f14_adx", ADX_SQL + "SELECT symbol, date, adx FROM adx", "bars")
def f14(spark, d):
    return folds(dealt_bars(spark, d), ["adx"]).select("symbol", "date", r("adx", 4).alias("adx"))


@query("f22_top_divergence_warning", SEEDED_SQL + "SELECT symbol, date FROM (SELECT symbol, date, high, macd_hist, max(high) OVER p AS top, max(macd_hist) OVER p AS peak FROM macd WINDOW p AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING)) WHERE high > top AND macd_hist < 0.8 * peak", "bars")
def f22(spark, d):
    rows = folds(dealt_bars(spark, d), ["macd_hist"]).withColumn("macd_hist", r("macd_hist", 4))
    before = ind.by_date().rowsBetween(-19, -1)
    rows = rows.withColumns({"top": F.max("high").over(before), "peak": F.max("macd_hist").over(before)})
    return rows.where("high > top and macd_hist < 0.8 * peak").select("symbol", "date")
