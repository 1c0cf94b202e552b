"""Queries of signals that windows express (L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import bars as period
from barloom.operators import cross, strategies
from barloom.operators.scans import indicators as folds
from barloom.plans.catalog import query
from barloom.plans.indicators import ADX_SQL, EMA_SQL, O, w
from barloom.plans.market import WEEK, resampled
from barloom.sources import daily_bars, dealt_bars


def cross_sql(source: str, level: str, rising: str, volume: bool) -> str:
    spans = cross.AVERAGES[level]
    mas = ", ".join(f"CASE WHEN count(close) {w(n)} = {n} THEN round(avg(close) {w(n)}, 2) END AS ma{n}" for n in spans)
    lags = ", ".join(f"lag(ma{n}) {O} AS p{n}" for n in spans)
    rules = " AND ".join([f"close > ma{n} AND pclose <= p{n}" for n in spans])
    top = spans[-1]
    if rising == "strict":
        rules += f" AND ma{top} > p{top}"
    elif rising != "none":
        rules += f" AND ma{top} >= p{top}"
        if rising == "slope":
            rules += " AND n4 = 4 AND sl >= -1e-6"
    if volume:
        rules += " AND pvolume > 1e-6 AND volume >= 1.5 * pvolume"
    return f"""m AS (SELECT symbol, date, close, volume, row_number() {O} - 1 AS bar_idx, {mas} FROM {source}),
l AS (SELECT *, lag(close) {O} AS pclose, lag(volume) {O} AS pvolume, {lags}, count(ma{top}) {w(4)} AS n4, regr_slope(ma{top}, bar_idx) {w(4)} AS sl FROM m)
SELECT symbol, date, round(close, 6) AS close FROM l WHERE {rules}"""


def out(df):
    return df.select("symbol", "date", F.round("close", 6).alias("close"))


def weeks(spark, d):
    return period.spine(daily_bars(spark, d), "week")


SPINE = f"""
w AS ({resampled(WEEK)}), e AS (SELECT symbol, min(period) AS a, max(period) AS z FROM w GROUP BY 1), s AS (SELECT symbol, CAST(unnest(generate_series(a, z, INTERVAL 7 DAY)) AS DATE) AS date FROM e),
weeks AS (SELECT s.symbol, s.date, close, coalesce(volume, 0) AS volume FROM s LEFT JOIN w ON w.symbol = s.symbol AND w.period = s.date)"""
MONTHS = f"months AS (SELECT symbol, period AS date, close, volume FROM ({resampled('last_day(date)')}))"


@query("l03_multi_level_cross_daily", "WITH " + cross_sql("bars", "daily", "strict", True), "bars")
def l03(spark, d):
    return out(cross.multi_level_cross(daily_bars(spark, d), "daily"))


@query("l03_multi_level_cross_bare", "WITH " + cross_sql("bars", "daily", "none", False), "bars")
def l03_bare(spark, d):
    return out(cross.multi_level_cross(daily_bars(spark, d), "daily", "none", None))


@query("l03_multi_level_cross_weekly", "WITH " + SPINE.strip() + ", " + cross_sql("weeks", "weekly", "slope", True), "bars")
def l03_weekly(spark, d):
    return out(cross.multi_level_cross(weeks(spark, d), "weekly", "slope"))


@query("l03_multi_level_cross_monthly", "WITH " + MONTHS + ", " + cross_sql("months", "monthly", "none", False), "bars")
def l03_monthly(spark, d):
    return out(cross.multi_level_cross(period.resample(daily_bars(spark, d), F.last_day("date")), "monthly", "none", None))


def older_sql(source: str, level: str, name: str, flat: bool, volume: bool, skip: int, gate: str) -> str:
    spans = cross.AVERAGES[level]
    mas = ", ".join(f"CASE WHEN count(close) {w(n)} = {n} THEN round(avg(close) {w(n)}, 2) END AS ma{n}" for n in spans)
    lags = ", ".join(f"lag(ma{n}) {O} AS p{n}" for n in spans)
    top = spans[-1]
    rules = [f"k >= {skip}"] + [f"close > ma{n} AND pclose <= p{n}" for n in spans] + [f"ma{top} >= p{top}"] * flat + ["pvolume > 1e-6 AND volume >= 1.5 * pvolume"] * volume
    rules += [f"(n < 4 OR round(final, 9) >= {gate})"] if gate else []
    tail = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    known = " AND ".join(f"{c} IS NOT NULL" for c in ("close", "volume", *(f"ma{n}" for n in spans)))
    return f"""{name}1 AS (SELECT symbol, date, close, volume, {mas} FROM {source}), {name}2 AS (SELECT *, row_number() {O} - 1 AS k, lag(close) {O} AS pclose, lag(volume) {O} AS pvolume, {lags} FROM {name}1 WHERE {known}),
{name}3 AS (SELECT *, regr_slope(ma{top}, k) {w(4)} AS sl, count(*) {tail} AS n FROM {name}2), {name}4 AS (SELECT *, last_value(sl) {tail} AS final FROM {name}3), {name} AS (SELECT symbol, date, '{level}' AS timeframe FROM {name}4 WHERE {' AND '.join(rules)})"""


def months(spark, d):
    return period.spine(daily_bars(spark, d), "month")


MONTH_SPINE = f"""
mw AS ({resampled('last_day(date)')}), me AS (SELECT symbol, date_trunc('month', min(period)) AS a, date_trunc('month', max(period)) AS z FROM mw GROUP BY 1), ms AS (SELECT symbol, last_day(CAST(unnest(generate_series(a, z, INTERVAL 1 MONTH)) AS DATE)) AS date FROM me),
months AS (SELECT ms.symbol, ms.date, close, coalesce(volume, 0) AS volume FROM ms LEFT JOIN mw ON mw.symbol = ms.symbol AND mw.period = ms.date)"""
LEVELS = f"WITH {SPINE.strip()}, {MONTH_SPINE.strip()}, "
THREE = " SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c"


def three(spark, d, *each):
    found = [cross.older_cross(rows(spark, d), level, **options).select("symbol", "date", F.lit(level).alias("timeframe")) for rows, level, options in each]
    return found[0].union(found[1]).union(found[2])


@query("l04_multi_level_cross_flat", LEVELS + ", ".join([older_sql("bars", "daily", "a", True, True, 30, ""), older_sql("weeks", "weekly", "b", False, True, 30, "-1e-6"), older_sql("months", "monthly", "c", False, False, 12, "")]) + THREE, "bars")
def l04(spark, d):
    return three(spark, d, (daily_bars, "daily", {"flat": True, "volume": 1.5, "skip": 30}), (weeks, "weekly", {"volume": 1.5, "skip": 30, "gate": -1e-6}), (months, "monthly", {"skip": 12}))


@query("l05_multi_level_cross_last_only", LEVELS + ", ".join([older_sql("bars", "daily", "a", True, True, 1, ""), older_sql("weeks", "weekly", "b", False, True, 1, "0"), older_sql("months", "monthly", "c", False, False, 1, "")]) + THREE, "bars")
def l05(spark, d):
    return three(spark, d, (daily_bars, "daily", {"flat": True, "volume": 1.5}), (weeks, "weekly", {"volume": 1.5, "gate": 0.0}), (months, "monthly", {}))


@query("l05_weekly_of_dense_weeks", f"WITH w AS ({resampled(WEEK)}), weeks AS (SELECT symbol, period AS date, close, volume FROM w), " + older_sql("weeks", "weekly", "b", False, True, 1, "0") + " SELECT * FROM b", "bars")
def l05w(spark, d):
    """The weekly rule where weeks without trades are left out, so that averages are full."""
    return cross.older_cross(period.weekly(daily_bars(spark, d)), "weekly", volume=1.5, gate=0.0).select("symbol", "date", F.lit("weekly").alias("timeframe"))


def full(n: int, places: int = 6) -> str:
    return f"CASE WHEN count(close) {w(n)} = {n} THEN round(avg(close) {w(n)}, {places}) END"


@query("f05_golden_cross", f"WITH m AS (SELECT symbol, date, {full(5)} AS f, {full(20)} AS s FROM bars), v AS (SELECT * FROM m WHERE s IS NOT NULL) SELECT symbol, date FROM (SELECT *, lag(f) {O} AS pf, lag(s) {O} AS ps FROM v) WHERE f > s AND pf <= ps", "bars")
def f05(spark, d):
    return cross.golden_cross(daily_bars(spark, d))


@query("f06_bullish_alignment", f"WITH m AS (SELECT symbol, date, {full(5)} AS a, {full(10)} AS b, {full(20)} AS c FROM bars) SELECT symbol, date FROM m WHERE a > b AND b > c", "bars")
def f06(spark, d):
    return cross.bullish(daily_bars(spark, d))


@query("f12_turtle", "WITH m AS (SELECT symbol, date, close, CASE WHEN count(high) OVER p = 20 THEN max(high) OVER p END AS top FROM bars WINDOW p AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) SELECT symbol, date FROM m WHERE close > top", "bars")
def f12(spark, d):
    return cross.turtle(daily_bars(spark, d))


@query("f13_bollinger", f"WITH m AS (SELECT symbol, date, close, CASE WHEN count(close) {w(20)} = 20 THEN round(avg(close) {w(20)} + 2 * stddev_samp(close) {w(20)}, 6) END AS band FROM bars) SELECT symbol, date FROM m WHERE round(close, 6) > band", "bars")
def f13(spark, d):
    return cross.bollinger(daily_bars(spark, d))


@query("l10_average_signals", f"WITH m AS (SELECT symbol, date, {full(5)} AS f, {full(20)} AS s, {full(10)} AS t FROM bars), v AS (SELECT *, lag(f) {O} AS pf, lag(s) {O} AS ps FROM m WHERE s IS NOT NULL) SELECT symbol, date AS signal_date, 'golden_cross' AS strategy FROM v WHERE f > s AND pf <= ps UNION ALL SELECT symbol, date, 'bullish' FROM v WHERE f > t AND t > s", "bars")
def l10(spark, d):
    bars = daily_bars(spark, d)
    a, b = cross.golden_cross(bars).withColumn("strategy", F.lit("golden_cross")), cross.bullish(bars).withColumn("strategy", F.lit("bullish"))
    return a.union(b).withColumnRenamed("date", "signal_date")


@query("l11_rsi_rebound", EMA_SQL + f", q AS (SELECT symbol, date, CASE WHEN down > 0 THEN round(100 - 100 / (1 + up / down), 4) WHEN up > 0 THEN 100 END AS rsi FROM e), p AS (SELECT *, lag(rsi) {O} AS prsi FROM q) SELECT symbol, date FROM p WHERE rsi < 30 AND prsi < 30 AND rsi > prsi", "bars")
def l11(spark, d):
    return strategies.rsi_rebound(dealt_bars(spark, d)).select("symbol", "date")


@query("l11_macd_divergence", EMA_SQL + f", q AS (SELECT symbol, date, round(close, 6) AS close, round(2 * (e12 - e26 - dea), 4) AS bar FROM e), p AS (SELECT *, min(close) OVER b AS low, min(bar) {w(5)} AS least, count(*) {w(5)} AS n FROM q WINDOW b AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)) SELECT symbol, date FROM p WHERE n = 5 AND close < low AND bar > least", "bars")
def l11b(spark, d):
    return strategies.macd_divergence(dealt_bars(spark, d)).select("symbol", "date")


@query("l12_adx_trend", ADX_SQL + "SELECT symbol, date FROM adx WHERE adx > 25", "bars")
def l12(spark, d):
    return folds(dealt_bars(spark, d), ["adx"]).where("round(adx, 4) > 25").select("symbol", "date")


@query("l13_pattern_stubs", "SELECT symbol, date AS signal_date, '' AS strategy FROM bars WHERE false", "bars")
def l13(spark, d):
    return daily_bars(spark, d).where(F.lit(False)).select("symbol", F.col("date").alias("signal_date"), F.lit("").alias("strategy"))


@query("l15_value_filter", "SELECT s_suppkey AS symbol, round(s_acctbal, 2) AS profit FROM supplier WHERE s_acctbal > 1000 AND s_suppkey / 10.0 < 20 QUALIFY row_number() OVER (ORDER BY s_suppkey) <= 200")
def l15(spark, d):
    from barloom.sources import read

    kept = read(spark, d, "supplier").where("s_acctbal > 1000 and s_suppkey / 10.0 < 20").orderBy("s_suppkey").limit(200)
    return kept.select(F.col("s_suppkey").alias("symbol"), F.round("s_acctbal", 2).alias("profit"))
