"""Queries of sequence structures, their strategies and the backtest (K, L1, L2, L6-L9, P)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom import functions as fn
from barloom.operators import bars as period
from barloom.operators import chan, chan_blocks, enhanced, pullback, strategies
from barloom.plans.catalog import query
from barloom.plans.indicators import O, w
from barloom.plans.signals import full
from barloom.sources import daily_bars, last_day, walk_bars
from barloom.sources.tables import written


#: dialect P bar by bar: the state of the last merged bar, pushed or joined at every row; mg has each merged bar's last state
MERGED = f"""
i AS (SELECT symbol, date, open, high, low, close, row_number() {O} - 1 AS k FROM bars), e AS (
  SELECT symbol, k, 0::BIGINT AS seq, high, low, open, close, k AS spot, 0 AS trend FROM i WHERE k = 0
  UNION ALL
  SELECT symbol, k, seq + CAST(how = 0 AS INT), CASE WHEN how = 0 OR (trend > 0 AND h >= high) OR (trend = 0 AND how = 2) THEN h ELSE high END,
    CASE WHEN how = 0 OR (trend = 0 AND how = 2) THEN lo WHEN trend < 0 THEN least(low, lo) ELSE low END, CASE WHEN how = 0 THEN o ELSE open END, c,
    CASE WHEN how = 0 OR (trend > 0 AND h >= high) OR (trend = 0 AND how = 2) THEN k ELSE spot END,
    CASE WHEN how = 0 THEN CAST(h > high AND lo > low AS INT) - CAST(h < high AND lo < low AS INT) ELSE trend END
  FROM (SELECT i.symbol, i.k, e.seq, e.high, e.low, e.open, e.spot, e.trend, i.high AS h, i.low AS lo, i.open AS o, i.close AS c,
      CASE WHEN i.high <= e.high AND i.low >= e.low THEN 1 WHEN i.high >= e.high AND i.low <= e.low THEN 2 ELSE 0 END AS how FROM e JOIN i ON i.symbol = e.symbol AND i.k = e.k + 1)
), lasts AS (SELECT symbol, seq, max(k) AS rw, arg_max(high, k) AS high, arg_max(low, k) AS low, arg_max(open, k) AS open, arg_max(close, k) AS close, arg_max(spot, k) AS spot, arg_max(trend, k) AS trend FROM e GROUP BY 1, 2),
mg AS (SELECT l.*, a.date AS at_date, r.date AS row_date FROM lasts l JOIN i a ON a.symbol = l.symbol AND a.k = l.spot JOIN i r ON r.symbol = l.symbol AND r.k = l.rw)"""
MO = "OVER (PARTITION BY symbol ORDER BY seq)"


def way_sql(before: str, after: str) -> str:
    """1 where both ends rise from one bar to the other, -1 where both fall, else 0; names of their high and low."""
    (h1, l1), (h2, l2) = before.split(), after.split()
    return f"(CASE WHEN {h2} > {h1} AND {l2} > {l1} THEN 1 WHEN {h2} < {h1} AND {l2} < {l1} THEN -1 ELSE 0 END)"


def directed(backtest: bool) -> str:
    back, ahead = way_sql("ph pl", "high low"), way_sql("high low", "nh nl")
    rule = f"CASE WHEN seq > 0 THEN {back} ELSE {ahead} END" if backtest else f"CASE WHEN seq > 0 AND {back} <> 0 THEN {back} WHEN {ahead} <> 0 THEN {ahead} WHEN close >= open THEN 1 ELSE -1 END"
    return f"nb AS (SELECT *, lag(high) {MO} AS ph, lag(low) {MO} AS pl, lead(high) {MO} AS nh, lead(low) {MO} AS nl FROM mg), dr AS (SELECT *, {rule} AS way FROM nb)"


def fractals_sql(reach: int) -> str:
    side = lambda f, c, a, b: f"{f}({c}) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN {a} AND {b})"
    before, after = (f"{reach} PRECEDING", "1 PRECEDING"), ("1 FOLLOWING", f"{reach} FOLLOWING")
    whole = f"{side('count', '*', *before)} = {reach} AND {side('count', '*', *after)} = {reach}"
    return f"""fx AS (SELECT *, {whole} AS whole, high > {side('max', 'high', *before)} AND high > {side('max', 'high', *after)} AS top, low < {side('min', 'low', *before)} AND low < {side('min', 'low', *after)} AS bottom FROM mg),
fr AS (SELECT *, row_number() {MO} - 1 AS n, CASE WHEN top THEN 1 ELSE -1 END AS kind, CASE WHEN top THEN high ELSE low END AS price FROM fx WHERE whole AND top <> bottom)"""


def strokes_sql(rule: chan.StrokeRule, reach: int) -> str:
    if rule.collapse:
        ends = f"""g1 AS (SELECT *, CASE WHEN kind = lag(kind) {MO} THEN 0 ELSE 1 END AS fresh FROM fr), g2 AS (SELECT *, sum(fresh) {MO} AS run FROM g1),
fs AS (SELECT * EXCLUDE (n, best), row_number() {MO} - 1 AS n FROM (SELECT *, row_number() OVER (PARTITION BY symbol, run ORDER BY kind * price DESC, seq {'DESC' if rule.collapse == 'equal' else 'ASC'}) AS best FROM g2) WHERE best = 1)"""
    else:
        ends = "fs AS (SELECT * FROM fr)"
    near = "(f.kind = 1 AND f.high > s.low OR f.kind = -1 AND f.low < s.high)"
    far = "(f.kind = 1 AND f.high > s.high OR f.kind = -1 AND f.low < s.low)"
    good = f"f.kind <> s.kind AND f.seq - s.seq - 1 >= {rule.gap} AND {far if rule.past == 'far' else near}"
    stay = f"f.kind = s.kind AND f.kind * f.price <= s.kind * s.price" + (f" OR f.kind <> s.kind AND NOT ({good})" if rule.hold else "")
    return f"""{fractals_sql(reach)}, {ends}, st AS (
  SELECT symbol, n, seq, kind, high, low, price, NULL::BIGINT AS a, NULL::BIGINT AS b FROM fs WHERE n = 0
  UNION ALL
  SELECT f.symbol, f.n, CASE WHEN {stay} THEN s.seq ELSE f.seq END, CASE WHEN {stay} THEN s.kind ELSE f.kind END, CASE WHEN {stay} THEN s.high ELSE f.high END, CASE WHEN {stay} THEN s.low ELSE f.low END,
    CASE WHEN {stay} THEN s.price ELSE f.price END, CASE WHEN {good} THEN s.seq END, CASE WHEN {good} THEN f.seq END
  FROM st s JOIN fs f ON f.symbol = s.symbol AND f.n = s.n + 1
), sk AS (SELECT x.symbol, row_number() OVER (PARTITION BY x.symbol ORDER BY x.n) - 1 AS seq, CASE WHEN e.kind = 1 THEN 'up' ELSE 'down' END AS type, s.row_date AS start_date, e.row_date AS end_date, s.price AS start_price, e.price AS end_price,
  greatest(s.high, e.high) AS high, least(s.low, e.low) AS low, e.spot AS value FROM st x JOIN fs s ON s.symbol = x.symbol AND s.seq = x.a JOIN fs e ON e.symbol = x.symbol AND e.seq = x.b)"""


SHOWN = "CAST(seq AS INTEGER) AS seq, {type} AS type, {start} AS start_date, {end} AS end_date, {sp} AS start_price, {ep} AS end_price, high, low, CAST({value} AS DOUBLE) AS value"


def structure_sql(kind: str, rule: str, reach: int) -> str:
    head = f"WITH RECURSIVE {MERGED.strip()}, "
    if kind == "merged":
        return head + directed(chan.RULES[rule].hold) + " SELECT symbol, " + SHOWN.format(type="CAST(way AS VARCHAR)", start="at_date", end="row_date", sp="open", ep="close", value="trend") + " FROM dr"
    if kind == "fractal":
        shown = SHOWN.replace("CAST(seq AS", "CAST(n AS").format(type="CASE WHEN top THEN 'top' ELSE 'bottom' END", start="row_date", end="row_date", sp="price", ep="price", value="seq")
        return head + fractals_sql(reach) + f" SELECT symbol, {shown} FROM fr"
    return head + strokes_sql(chan.RULES[rule], reach) + " SELECT symbol, " + SHOWN.format(type="type", start="start_date", end="end_date", sp="start_price", ep="end_price", value="value") + " FROM sk"


def structure(name, kind, dialect, rule="pullback", reach=1, source=daily_bars, table="bars"):
    def run(spark, d):
        rows = chan.structures(source(spark, d), dialect, rule, reach, (kind,))
        prices = ("start_price", "end_price", "high", "low", "value")
        return rows.select("symbol", "seq", "type", "start_date", "end_date", *[F.round(c, 4).alias(c) if dialect == "C" else c for c in prices])

    query(name, *([structure_sql(kind, rule, reach), table] if dialect == "P" else []))(run)


structure("k01_p_merged_bars", "merged", "P")
structure("k01_c_merged_bars", "merged", "C")
structure("k03_p_fractals", "fractal", "P")
structure("k03_p_fractals_reach_2", "fractal", "P", "breakout", 2)
structure("k03_c_fractals", "fractal", "C")
structure("k04_p1_strokes_pullback", "stroke", "P", "pullback")
structure("k04_p2_strokes_breakout", "stroke", "P", "breakout")
structure("k04_p3_strokes_weekly", "stroke", "P", "weekly")
structure("k04_p3_strokes_monthly", "stroke", "P", "monthly")
structure("k04_p4_strokes_backtest", "stroke", "P", "backtest")
structure("k04_c_strokes", "stroke", "C")
structure("k05_c_segments", "segment", "C")
structure("k06_c_pivots", "pivot", "C")
structure("k07_c_divergences", "divergence", "C")
structure("k08_c_points", "point", "C")


def directions(name, rule):
    def run(spark, d):
        rows = chan.structures(daily_bars(spark, d), "P", rule, kinds=("merged",))
        return rows.select("symbol", "seq", F.col("end_date").alias("date"), F.col("type").cast("int").alias("direction"))

    sql = f"WITH RECURSIVE {MERGED.strip()}, {directed(chan.RULES[rule].hold)} SELECT symbol, CAST(seq AS INTEGER) AS seq, row_date AS date, way AS direction FROM dr"
    query(name, sql, "bars")(run)


directions("k02_p_directions", "pullback")
directions("k02_p_directions_backtest", "backtest")


CUT = 64  # bars of a block, so that the driver's symbols fall into several


def cut(name, kind, rule="pullback", reach=1):
    """The same structures where a symbol's history is cut into blocks."""

    def run(spark, d):
        bars = chan_blocks.merged(daily_bars(spark, d), CUT)[0]
        if kind == "merged":
            rows = chan_blocks.directed(bars, chan.RULES[rule].hold)
            return rows.select("symbol", F.col("seq").cast("int"), F.col("way").cast("string").alias("type"), F.col("at_date").alias("start_date"), F.col("row_date").alias("end_date"), F.col("open").alias("start_price"), F.col("close").alias("end_price"), "high", "low", F.col("trend").cast("double").alias("value"))
        marks = chan_blocks.fractals(bars, reach)
        if kind == "fractal":
            return marks.select("symbol", F.col("n").cast("int").alias("seq"), F.when(F.col("kind") == 1, "top").otherwise("bottom").alias("type"), F.col("row_date").alias("start_date"), F.col("row_date").alias("end_date"), F.col("price").alias("start_price"), F.col("price").alias("end_price"), "high", "low", F.col("seq").cast("double").alias("value"))
        return chan_blocks.strokes(marks, rule, CUT)[0].select("symbol", F.col("seq").cast("int"), "type", "start_date", "end_date", "start_price", "end_price", "high", "low", "value")

    query(name, structure_sql(kind, rule, reach), "bars")(run)


cut("k01_p_merged_bars_in_blocks", "merged")
cut("k03_p_fractals_in_blocks", "fractal", "breakout", 2)
cut("k04_p1_strokes_in_blocks", "stroke", "pullback")
cut("k04_p2_strokes_breakout_in_blocks", "stroke", "breakout")
cut("k04_p3_strokes_weekly_in_blocks", "stroke", "weekly")
cut("k04_p4_strokes_backtest_in_blocks", "stroke", "backtest")


@query("k09_c_pipeline")
def k09(spark, d):
    return chan.structures(daily_bars(spark, d), "C").groupBy("symbol", "kind").agg(F.count("*").alias("n"))


K10 = f"WITH RECURSIVE {MERGED.strip()}, {strokes_sql(chan.RULES['breakout'], 1)} SELECT symbol, CAST(seq AS INTEGER) AS seq, end_date, end_price FROM (SELECT *, lead(type) {MO} AS next, lead(start_date) {MO} AS next_start FROM sk) WHERE type = 'up' AND next = 'down' AND next_start = end_date"


@query("k10_completed_up_strokes", K10, "bars")
def k10(spark, d):
    strokes = chan.structures(daily_bars(spark, d), "P", "breakout", kinds=("stroke",))
    turn = Window.partitionBy("symbol").orderBy("seq")
    rows = strokes.withColumns({"next": F.lead("type").over(turn), "next_start": F.lead("start_date").over(turn)})
    return rows.where("type = 'up' and next = 'down' and next_start = end_date").select("symbol", "seq", "end_date", "end_price")


@query("e17_strength_of_strokes")
def e17(spark, d):
    return chan.structures(daily_bars(spark, d), "C", kinds=("stroke",)).select("symbol", "seq", F.round("value", 4).alias("strength"))


def signals(df):
    return df.select("symbol", "signal_date", "strategy_name", "signal_type", "timeframe", F.round("score", 4).alias("score"), F.round("level", 4).alias("level"))


def screened(name):
    """The strategy's signals of the last day of all bars: symbols whose last bar is older have none."""

    def run(spark, d):
        return signals(strategies.screen(daily_bars(spark, d), last_day(spark, d), [strategies.REGISTRY[name]]))

    return run


query("l01_pullback_daily")(screened("AdaptedMAPullback"))
query("l02_breakout")(screened("ChanBreakout"))
query("l06_pullback_weekly")(screened("WeeklyMAPullback"))
query("l07_pullback_monthly")(screened("MonthlyMAPullback"))


ENHANCED_SQL = f"""
WITH m AS (SELECT *, row_number() {O} - 1 AS k, {full(5, 2)} AS ma5, {full(30, 2)} AS ma30 FROM bars),
c AS (SELECT *, regr_slope(ma30, k) {w(5)} AS slope, count(ma30) {w(5)} AS n, k >= 33 AND high >= 1.2 * ma30 AS tall,
  high = max(high) OVER a AS top, high = max(high) OVER b AS near_top, low = min(low) OVER a AS dip, low = min(low) OVER b AS near_dip FROM m
  WINDOW a AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), b AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)),
s AS (SELECT *, max(CASE WHEN top AND tall THEN k END) OVER u AS far_peak, CASE WHEN lag(near_top AND tall) {O} THEN k - 1 END AS near_peak, max(CASE WHEN dip THEN k END) OVER u AS far_low, CASE WHEN lag(near_dip) {O} THEN k - 1 END AS near_low FROM c
  WINDOW u AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)),
t AS (SELECT *, coalesce(near_peak, far_peak) AS peak, coalesce(near_low, far_low) AS at FROM s),
v AS (SELECT *, min(low) OVER (PARTITION BY symbol ORDER BY k ROWS BETWEEN coalesce(k - peak - 1, 0) PRECEDING AND CURRENT ROW) AS least FROM t),
g AS (SELECT * FROM v WHERE k >= 78 AND peak IS NOT NULL AND n = 5 AND slope >= -1e-6 AND close > ma30 AND ma5 > ma30 AND (close - ma30) / ma30 <= 0.05)
SELECT g.symbol, g.date, p.high AS peak, CASE WHEN g.k - g.peak < 5 THEN q.low WHEN g.at >= g.peak + 5 THEN r.low ELSE g.least END AS low
FROM g JOIN m p ON p.symbol = g.symbol AND p.k = g.peak JOIN m q ON q.symbol = g.symbol AND q.k = g.k - 1 LEFT JOIN m r ON r.symbol = g.symbol AND r.k = g.at"""


@query("l08_enhanced_buy", ENHANCED_SQL, "bars")
def l08(spark, d):
    return enhanced.buys(daily_bars(spark, d))


@query("l08_enhanced_buy_walk", ENHANCED_SQL, "walk")
def l08_walk(spark, d):
    return enhanced.buys(walk_bars(spark, d))


@query("l09_enhanced_sell_walk")
def l09_walk(spark, d):
    return pullback.enhanced(walk_bars(spark, d)).where("action <> 'BUY'").select("symbol", "date", F.col("action").alias("sell"), F.round("price", 4).alias("price"))


@query("l09_enhanced_sell")
def l09(spark, d):
    return pullback.enhanced(daily_bars(spark, d)).where("action <> 'BUY'").select("symbol", "date", F.col("action").alias("sell"), F.round("price", 4).alias("price"))


@query("p01_backtest_trades")
def p01(spark, d):
    rows = pullback.backtest(daily_bars(spark, d))
    return rows.select("symbol", "seq", "date", "action", "size", *[F.round(c, 2).alias(c) for c in ("price", "fee", "cash", "equity", "profit")])


@query("p03_position_size", "SELECT symbol, date, floor(least(0.2 * 1000000, 1000000) / close / 100) * 100 AS size FROM bars", "bars")
def p03(spark, d):
    return daily_bars(spark, d).select("symbol", "date", (F.floor(F.least(F.lit(0.2 * 1000000), F.lit(1000000.0)) / F.col("close") / 100) * F.lit(100.0)).alias("size"))


@query("p05_commission", "SELECT l_orderkey, l_linenumber, round(greatest(l_extendedprice * 0.0002, 5), 4) AS fee FROM lineitem")
def p05(spark, d):
    from barloom.sources import read

    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.greatest(F.col("l_extendedprice") * 0.0002, F.lit(5.0)), 4).alias("fee"))


@query("p06_trade_statistics")
def p06(spark, d):
    """Trades, win rate, means, profit factor and SQN from the sells; drawdown, annual return and Sharpe ratio from daily equity."""
    bars = daily_bars(spark, d)
    sells = pullback.backtest(bars).where("action <> 'buy'")
    win, loss = F.when(F.col("profit") > 0, F.col("profit")), F.when(F.col("profit") <= 0, F.col("profit"))
    trades = sells.groupBy("symbol").agg(
        F.count("*").alias("trades"), F.round(F.avg((F.col("profit") > 0).cast("int")), 4).alias("win_rate"), F.round(F.avg(win), 2).alias("mean_win"), F.round(F.avg(loss), 2).alias("mean_loss"),
        F.round(F.try_divide(F.sum(win), -F.sum(loss)), 4).alias("profit_factor"),
        F.round(F.try_divide(F.sqrt(F.count("*")) * F.avg("profit"), F.stddev_samp("profit")), 4).alias("sqn"),
    )
    return account_statistics(pullback.daily_equity(bars)).join(trades, "symbol", "left")


def account_statistics(equity, start: float = 1_000_000.0, free: float = 0.01):
    """Per symbol: greatest fall of equity (symbol, date, equity) from its peak so far, mean annual return, yearly Sharpe ratio."""
    w = Window.partitionBy("symbol").orderBy("date")
    fall = 1 - F.try_divide("equity", F.greatest(F.lit(start), F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    falls = equity.withColumn("fall", fall).groupBy("symbol", F.year("date").alias("year")).agg(F.max("fall").alias("fall"), F.max_by("equity", "date").alias("equity"))
    years = falls.withColumn("ret", F.try_divide("equity", F.coalesce(F.lag("equity").over(Window.partitionBy("symbol").orderBy("year")), F.lit(start))) - 1)
    return years.groupBy("symbol").agg(
        F.round(F.max("fall"), 6).alias("drawdown"), F.round(F.avg("ret"), 6).alias("annual_return"),
        F.round(F.try_divide(F.avg("ret") - free, F.nullif(F.round(F.stddev_pop("ret"), 12), F.lit(0.0))), 4).alias("sharpe"),
    )


@query("p06_drawdown", "WITH e AS (SELECT symbol, date, close / max(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS fall FROM bars) SELECT symbol, round(min(fall), 6) AS drawdown FROM e GROUP BY 1", "bars")
def p06b(spark, d):
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = daily_bars(spark, d).select("symbol", (F.try_divide(F.col("close"), F.max("close").over(w)) - 1).alias("fall"))
    return rows.groupBy("symbol").agg(fn.signed_round(F.min("fall"), 6).alias("drawdown"))


@query("p07_buy_and_hold", "SELECT symbol, round(arg_max(close, date) / arg_min(close, date) - 1, 6) AS ret FROM bars GROUP BY 1", "bars")
def p07(spark, d):
    return daily_bars(spark, d).groupBy("symbol").agg(fn.signed_round(F.try_divide(F.max_by("close", "date"), F.min_by("close", "date")) - 1, 6).alias("ret"))


#: bars that walk, on which the rules find something: structures, and the strategies as of every second month
for _kind, _dialect, _rule in (("merged", "P", "pullback"), ("fractal", "P", "pullback"), ("stroke", "P", "weekly"), ("stroke", "P", "backtest"), ("segment", "C", "pullback"), ("pivot", "C", "pullback"), ("divergence", "C", "pullback"), ("point", "C", "pullback")):
    structure(f"k_{_dialect.lower()}_{_kind}_{_rule}_walk" if _dialect == "P" else f"k_c_{_kind}_walk", _kind, _dialect, _rule, source=walk_bars, table="walk")
DAYS = [f"{y}-{m:02d}-15" for y in (1997, 1998, 1999, 2000) for m in (1, 3, 5, 7, 9, 11)]


def over_days(bars, wanted):
    """The bars up to the days of wanted (symbol, n, to); symbol * 100 + the day's number stands for the symbol."""
    rows = bars.join(wanted, "symbol").where(F.col("date") <= F.col("to"))
    return rows.withColumn("symbol", F.col("symbol") * 100 + F.col("n")).drop("n", "to")


def as_of_days(name, run, wanted):
    """Signals as of each of DAYS; only the histories whose last bar may give one (wanted) are looked at."""

    def found(spark, d):
        bars = written(walk_bars(spark, d), "walk")
        rows = run(written(over_days(bars, wanted(bars)), "histories")).where("signal_type = 'BUY'")
        return rows.select(F.floor(F.col("symbol") / 100).alias("symbol"), (F.col("symbol") % 100).alias("day"), "signal_date", "timeframe", F.round("score", 6).alias("score"), F.round("level", 6).alias("level"))

    query(name)(found)


def _weeks(bars):
    return period.weekly(bars).drop("last")


def _months(bars):
    return period.monthly(bars).drop("last")


as_of_days("l01_pullback_over_days", lambda bars: pullback.pullback(bars, pullback.DAILY, _weeks(bars)), lambda bars: pullback.pullback_days(bars, DAYS, pullback.DAILY))
as_of_days("l02_breakout_over_days", pullback.breakout, lambda bars: pullback.breakout_days(bars, DAYS))
as_of_days("l06_pullback_weekly_over_days", lambda bars: pullback.pullback(_weeks(bars), pullback.WEEKLY, _months(bars)), lambda bars: pullback.pullback_days(bars, DAYS, pullback.WEEKLY, fn.week_friday(F.col("date"))))
as_of_days("l07_pullback_monthly_over_days", lambda bars: pullback.pullback(_months(bars), pullback.MONTHLY), lambda bars: pullback.pullback_days(bars, DAYS, pullback.MONTHLY, fn.business_month_end(F.col("date"))))
