"""Strategies as plug-ins, the screener over them, and its report.

A strategy is a name and a function of (frames, day, params) that returns SIGNALS rows; frames holds daily, weekly
and monthly bars up to the analysis day.  Functions that only mark (symbol, date) rows of bars join the registry by
``from_marks``.  A strategy that cannot be planned, or that fails on a symbol, leaves an ERROR row and the others go on.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom import functions as fn
from barloom.operators import bars as period
from barloom.operators import cross, pullback
from barloom.operators import indicators as ind
from barloom.operators.scans import indicators as folds
from barloom.sources.tables import laid_out, written

Frames = dict[str, DataFrame]


@dataclass(frozen=True)
class Strategy:
    """A plug-in: run(frames, day, **params) gives SIGNALS rows."""

    name: str
    run: Callable[..., DataFrame]
    params: dict = field(default_factory=dict)


def frames(bars: DataFrame, day: str | dt.date, lookback: int = 750, longer: int = 1500) -> Frames:
    """Daily bars of the last ``lookback`` days up to day; weeks and months of the last ``longer`` days, the unfinished ones dated day.

    The bars are read once, laid out by symbol; whatever works by symbol on any frame needs no further exchange.
    """
    at = F.lit(str(day)).cast("date")
    kept = laid_out(bars.where(F.col("date").between(F.date_sub(at, max(lookback, longer)), at)), "symbol", "date")
    out = {"daily": kept.where(F.col("date") >= F.date_sub(at, lookback))}
    long = kept.where(F.col("date") >= F.date_sub(at, longer))
    for name, unit, completed in (("weekly", "week", period.weekly), ("monthly", "month", period.monthly)):
        done = completed(long, F.date_trunc(unit, at).cast("date")).drop("last")
        out[name] = done.unionByName(period.dynamic(long, unit, at).select(done.columns))
    return out


def _rows(marks: DataFrame, name: str, timeframe: str) -> DataFrame:
    """SIGNALS rows of (symbol, date) marks."""
    none = F.lit(None).cast("double")
    return marks.select("symbol", F.col("date").alias("signal_date"), F.lit(name).alias("strategy_name"), F.lit("BUY").alias("signal_type"), F.lit(timeframe).alias("timeframe"), none.alias("score"), none.alias("level"), F.lit(None).cast("string").alias("notes"))


def multi_level_cross(given: Frames, day, volume: float = 1.5) -> DataFrame:
    """Daily, weekly (label Friday) and monthly (label calendar month end) crosses."""
    daily = given["daily"]
    levels = [
        ("Daily", cross.multi_level_cross(daily, "daily", "strict", volume)),
        ("Weekly", cross.multi_level_cross(period.spine(daily, "week"), "weekly", "slope", volume)),
        ("Monthly", cross.multi_level_cross(period.spine(daily, "month"), "monthly", "none", None)),
    ]
    return reduce(DataFrame.unionByName, [_rows(marks.select("symbol", "date"), "MultiLevelCross", timeframe) for timeframe, marks in levels])


def from_marks(name: str, marks: Callable[[DataFrame], DataFrame], timeframe: str = "Daily", frame: str = "daily") -> Strategy:
    """A strategy from a function of bars to (symbol, date) rows."""
    return Strategy(name, lambda given, day: _rows(marks(given[frame]).select("symbol", "date"), name, timeframe))


def rsi_rebound(bars: DataFrame) -> DataFrame:
    rows = folds(bars, ["rsi"]).withColumn("rsi", F.round("rsi", 4)).withColumn("prsi", ind.lag("rsi"))
    return rows.where("rsi < 30 and prsi < 30 and rsi > prsi")


def macd_divergence(bars: DataFrame) -> DataFrame:
    """The close is the lowest of five bars and the MACD bar is not."""
    rows = folds(bars, ["bar"]).select("symbol", "date", F.round("close", 6).alias("close"), F.round("bar", 4).alias("bar"))
    before = ind.by_date().rowsBetween(-4, -1)
    rows = rows.withColumns({"low": F.min("close").over(before), "least": F.min("bar").over(ind.over(5)), "n": F.count("*").over(ind.over(5))})
    return rows.where("n = 5 and close < low and bar > least")


def _adx_trend(bars: DataFrame) -> DataFrame:
    return folds(bars, ["adx"]).where("round(adx, 4) > 25")


def _nothing(bars: DataFrame) -> DataFrame:
    return bars.where(F.lit(False))


#: what the screener runs; those of pullback.PASSES share one grouped pass
SCREENED = [
    Strategy("AdaptedMAPullback", lambda given, day: pullback.pullback(given["daily"], pullback.DAILY, given["weekly"])),
    Strategy("MultiLevelCross", multi_level_cross),
    Strategy("ChanBreakout", lambda given, day, **options: pullback.breakout(given["daily"], **options)),
    Strategy("WeeklyMAPullback", lambda given, day: pullback.pullback(given["weekly"], pullback.WEEKLY, given["monthly"])),
    Strategy("MonthlyMAPullback", lambda given, day: pullback.pullback(given["monthly"], pullback.MONTHLY)),
]
#: the rules that only mark rows of bars
MARKS = [
    from_marks("GoldenCross", cross.golden_cross), from_marks("BullishAlignment", cross.bullish), from_marks("RSIRebound", rsi_rebound), from_marks("MACDDivergence", macd_divergence),
    from_marks("Turtle", cross.turtle), from_marks("Bollinger", cross.bollinger), from_marks("ADXTrend", _adx_trend),
    *(from_marks(name, _nothing) for name in ("DoubleBottom", "HeadAndShoulders", "Triangle", "Flag", "VReversal", "RoundBottom", "TripleBottom", "MultipleBottom", "TrendLine")),
]
REGISTRY = {x.name: x for x in [*SCREENED, *MARKS]}


def screen(bars: DataFrame, day: str | dt.date, strategies: list[Strategy] = SCREENED, params: dict[str, dict] | None = None, lookback: int = 750) -> DataFrame:
    """The signals of screened()."""
    return screened(bars, day, strategies, params, lookback)[0]


def screened(bars: DataFrame, day: str | dt.date, strategies: list[Strategy] = SCREENED, params: dict[str, dict] | None = None, lookback: int = 750) -> tuple[DataFrame, Frames]:
    """(all strategies' signals of the analysis day, without NO_SIGNAL, as a written table; the frames they were found in).  Failures are rows of signal_type ERROR.

    A symbol without bars on the day has no signal: what its last bar says belongs to an earlier day.
    """
    given, spark = frames(bars, day, lookback), bars.sparkSession
    at, found, options = F.lit(str(day)).cast("date"), [], {x.name: {**x.params, **(params or {}).get(x.name, {})} for x in strategies}
    together = [x.name for x in strategies if x.name in pullback.PASSES and x in SCREENED]
    if together:
        tagged = reduce(DataFrame.unionByName, [ending_from(given[name], at).select(F.lit(name).alias("frame"), *pullback.PRICED) for name in ("daily", "weekly", "monthly")])
        found.append(pullback.one_pass(tagged, {name: options[name] for name in together}))
    for x in strategies:
        if x.name in together:
            continue
        try:
            rows = x.run(given, day, **options[x.name])
            found.append(rows.select(pullback.NAMES))
        except Exception as error:  # one strategy must not stop the others
            row = (None, dt.date.fromisoformat(str(day)), x.name, "ERROR", None, None, None, str(error).splitlines()[0][:500])
            found.append(spark.createDataFrame([row], pullback.SIGNALS))
    rows = reduce(DataFrame.unionByName, found)
    return written(rows.where((F.col("signal_date") == at) & (F.col("signal_type") != "NO_SIGNAL")), "signals"), given


def ending_from(rows: DataFrame, day: Column) -> DataFrame:
    """The bars of the symbols whose last bar is of the day or has a later label.

    A pass over a frame dates its signal by the last bar, so it finds nothing of the day on other symbols; and a symbol with
    a daily bar on the day has an unfinished week and month dated by it, so its pass keeps the frames that it compares with.
    """
    return rows.withColumn("__last", F.max("date").over(Window.partitionBy("symbol"))).where(F.col("__last") >= day).drop("__last")


def ratio(x: Column) -> Column:
    """Two decimals, Infinity, -Infinity, or empty."""
    return F.when(x.isNull(), "").when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity").otherwise(F.format_string("%.2f", fn.rounded(x, 2)))


#: fixed values: the report's columns in order; the raw market cap may follow
REPORT = [
    "symbol", "stock_name", "signal_date", "strategy_name", "signal_level", "market_cap_formatted", "pe", "pb", "revenue_growth_yoy", "profit_growth_yoy", "peg_like_ratio",
    "net_profit_positive_3y_latest", "growth_positive", "pe_lt_30", "peg_like_lt_1", "tech_notes", "error_reason",
]


def report(signals: DataFrame, names: DataFrame, metrics: DataFrame, raw_cap: bool = False) -> DataFrame:
    """The REPORT columns of every signal as text; names has (symbol, stock_name), metrics one row per (symbol, signal_date).

    Signals of symbols that the list does not name are left out, as the list is what is screened.
    """
    rows = signals.join(names, "symbol").join(metrics, ["symbol", "signal_date"], "left")
    shown = {
        "symbol": F.col("symbol").cast("string"), "signal_date": F.date_format("signal_date", "yyyy-MM-dd"), "signal_level": F.col("timeframe"),
        "market_cap_formatted": fn.large_number(F.col("market_cap")), "tech_notes": F.col("notes"), "error_reason": F.nullif(F.col("error_reason"), F.lit("")),
    }
    shown |= {c: ratio(F.col(c)) for c in ("pe", "pb", "revenue_growth_yoy", "profit_growth_yoy", "peg_like_ratio")}
    shown |= {c: fn.yes_no(F.col(c)) for c in ("net_profit_positive_3y_latest", "growth_positive", "pe_lt_30", "peg_like_lt_1")}
    return rows.select(*[shown.get(c, F.col(c)).alias(c) for c in REPORT], *[F.col("market_cap")] * raw_cap)
