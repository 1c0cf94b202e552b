"""Pullback and breakout strategies and the backtest: per-symbol passes over sequence structures."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators import chan
from barloom.operators import indicators as ind
from barloom.operators.folds import atr

SIGNALS = "symbol long, signal_date date, strategy_name string, signal_type string, timeframe string, score double, level double, notes string"


@dataclass(frozen=True)
class Pullback:
    """Parameters of a pullback to an average: days (or bars) of pattern, average, peak ratio, gain span and ratio, band, stop."""

    name: str
    timeframe: str
    rule: str
    reach: int
    average: int
    peak: float
    span: int
    gain: float
    low: float
    high: float
    stop: float
    bars: int
    days: int = 0
    by_low: bool = False
    highest_only: bool = False


DAILY = Pullback("AdaptedMAPullback", "Daily", "pullback", 1, 30, 1.25, 30, 1.20, 0.97, 1.05, 0.97, 37, days=150, highest_only=True)
WEEKLY = Pullback("WeeklyMAPullback", "Weekly", "weekly", 1, 30, 1.20, 20, 1.25, 0.98, 1.03, 0.97, 30, by_low=True)
MONTHLY = Pullback("MonthlyMAPullback", "Monthly", "monthly", 1, 20, 1.20, 18, 1.30, 0.97, 1.05, 0.97, 20, by_low=True)


def rolling_mean(x: np.ndarray, n: int) -> np.ndarray:
    return pd.Series(x).rolling(n, min_periods=1).mean().to_numpy()


def broken(close, low, average, p: Pullback, peak: int, end: int) -> bool:
    """Whether a bar after the peak falls through the stop, or three closes in a row lie under the average."""
    part = slice(peak + 1, end)
    tested = low[part] if p.by_low else close[part]
    under = close[part] < average[part]
    runs = under[2:] & under[1:-1] & under[:-2] if len(under) > 2 else np.zeros(0, bool)
    return bool((tested < p.stop * average[part]).any() or runs.any())


def qualified_peak(bars: dict[str, np.ndarray], average: np.ndarray, peaks: list[int], p: Pullback) -> int | None:
    """The highest candidate that rose enough into its peak and was not broken since."""
    high, low, close = bars["high"], bars["low"], bars["close"]
    now = len(close) - 1
    some = sorted({i for i in [*peaks, now] if high[i] > p.peak * average[i]}, key=lambda i: (-high[i], -i))
    for i in some[:1] if p.highest_only else some:
        lo = max(0, i - p.span + 1)
        if high[lo : i + 1].max() / max(low[lo : i + 1].min(), 1e-12) >= p.gain and not broken(close, low, average, p, i, now + (not p.by_low)):
            return i
    return None


def _columns(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    return {c: pdf[c].to_numpy(float) for c in ("open", "high", "low", "close", "volume")}


def _peaks(bars, begin: int, p: Pullback) -> list[int]:
    m = chan.merge_p(*(bars[c][begin:].tolist() for c in ("high", "low", "open", "close")))
    found = chan.strokes_p(m, chan.fractals_p(m, p.reach), chan.RULES[p.rule])
    return [begin + m.at[b[0]] for _, b in found if b[1] == chan.TOP]


def _flat_or_up(x: np.ndarray) -> bool:
    return len(x) > 1 and round(x[-1], 2) >= round(x[-2], 2)


NAMES = [c.split()[0] for c in SIGNALS.split(", ")]
PRICED = ["symbol", "date", "open", "high", "low", "close", "volume"]


def pullback_signal(pdf: pd.DataFrame, above: pd.DataFrame, p: Pullback) -> tuple | None:
    """The SIGNALS row at one symbol's last bar, if any; see pullback."""
    pdf = pdf.dropna(subset=["open", "high", "low", "close"]).sort_values("date", ignore_index=True)
    if len(pdf) < p.bars:
        return None
    x, day = _columns(pdf), pd.to_datetime(pdf["date"])
    average, fast = rolling_mean(x["close"], p.average), rolling_mean(x["close"], 5)
    begin = int((day >= day.iloc[-1] - pd.Timedelta(days=p.days)).argmax()) if p.days else 0
    peak = qualified_peak(x, average, _peaks(x, begin, p), p)
    if peak is None:
        return None
    now = len(pdf) - 1
    good = x["close"][now] < x["high"][peak] and p.low * average[now] <= x["low"][now] <= p.high * average[now] and fast[now] > average[now] and _flat_or_up(average)
    if good and p.timeframe != "Monthly":
        above = above[pd.to_datetime(above["date"]) <= day.iloc[-1]].sort_values("date")
        long = rolling_mean(above["close"].to_numpy(float), 30)
        good = len(long) >= (30 if p.timeframe == "Weekly" else 1) and x["close"][now] > long[-1] and (p.timeframe != "Weekly" or _flat_or_up(long))
    if not good:
        return None
    return pdf["symbol"].iloc[0], pdf["date"].iloc[-1], p.name, "BUY", p.timeframe, x["close"][now] / average[now], x["high"][peak], None


def pullback(bars: DataFrame, p: Pullback, context: DataFrame | None = None) -> DataFrame:
    """Signals at each symbol's last bar.

    bars is of the strategy's own period; context (symbol, date, close) of the period above, whose 30-bar
    average (needed in full above months) the close has to exceed.
    """

    def run(pdf: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        row = pullback_signal(pdf, above, p)
        return pd.DataFrame([row] if row else [], columns=NAMES)

    above = (context if context is not None else bars.limit(0)).select("symbol", "date", "close")
    return bars.select(PRICED).groupBy("symbol").cogroup(above.groupBy("symbol")).applyInPandas(_isolated(run, p.name, p.timeframe), SIGNALS)


def _failed(pdf: pd.DataFrame, name: str, timeframe: str, error: Exception) -> tuple:
    return pdf["symbol"].iloc[0], pdf["date"].max(), name, "ERROR", timeframe, None, None, f"{type(error).__name__}: {error}"[:500]


def _isolated(run, name: str, timeframe: str):
    """run for one symbol: no bars give no rows, and a failure gives one row of type ERROR instead of ending the job."""

    def guarded(pdf: pd.DataFrame, *above: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=NAMES)
        try:
            return run(pdf, *above)
        except Exception as error:
            return pd.DataFrame([_failed(pdf, name, timeframe, error)], columns=NAMES)

    return (lambda pdf, above: guarded(pdf, above)) if run.__code__.co_argcount == 2 else (lambda pdf: guarded(pdf))


def breakout_signal(pdf: pd.DataFrame, rows: int = 505, days: int = 730, low_days: int = 750, reach: int = 1) -> tuple | None:
    """The SIGNALS row at one symbol's last bar, if any; see breakout."""
    pdf = pdf.dropna(subset=["open", "high", "low", "close"]).sort_values("date", ignore_index=True)
    full, pdf = pdf, pdf.tail(rows).reset_index(drop=True)
    if len(pdf) < 60:
        return None
    x, day = _columns(pdf), pd.to_datetime(pdf["date"])
    m = chan.merge_p(*(x[c].tolist() for c in ("high", "low", "open", "close")))
    found = chan.strokes_p(m, chan.fractals_p(m, reach), chan.RULES["breakout"])
    done = [m.at[b[0]] for (_, b), (c, _) in zip(found, found[1:]) if b[1] == chan.TOP and c == b]
    done = [i for i in done if day[i] >= day.iloc[-1] - pd.Timedelta(days=days)][::-1]
    ladder: list[int] = []
    for i in done:
        if len(ladder) < 3 and (not ladder or x["high"][i] > x["high"][ladder[-1]]):
            ladder.append(i)
    if len(ladder) < 3:
        return None
    now = len(pdf) - 1
    recent = full[pd.to_datetime(full["date"]) >= day.iloc[-1] - pd.Timedelta(days=low_days)]["low"].min()
    for i in ladder[::-1]:
        level = x["high"][i]
        since = x["low"][i + 1 : now]
        if len(since) and since.min() <= 0.8 * level and level <= 2 * recent and x["high"][now - 1] < level < x["high"][now] and x["volume"][now] > 2 * rolling_mean(x["volume"], 60)[now]:
            return pdf["symbol"].iloc[0], pdf["date"].iloc[-1], "ChanBreakout", "BUY", "Daily", x["high"][now] / level, level, None
    return None


def breakout(bars: DataFrame, rows: int = 505, days: int = 730, low_days: int = 750, reach: int = 1) -> DataFrame:
    """Signals at each symbol's last bar, where it passes one of three rising earlier peaks on double volume.

    Peaks are ends of completed up-strokes, newest first, each earlier one higher.  The deepest low since has
    to be at most 0.8 of the peak, the peak at most twice the low of the last ``low_days`` days.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row = breakout_signal(pdf, rows, days, low_days, reach)
        return pd.DataFrame([row] if row else [], columns=NAMES)

    return bars.select(PRICED).groupBy("symbol").applyInPandas(_isolated(run, "ChanBreakout", "Daily"), SIGNALS)


SLACK = 1e-6  # windows and pandas add up in another order


def _last_bars(rows: DataFrame, days: list[str]) -> DataFrame:
    """rows that are a symbol's last one up to some of the days, once for each such day: n (its place) and to."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(x).cast("date").alias("to")) for n, x in enumerate(days)])).alias("d")
    rows = rows.withColumn("__next", F.lead("date").over(ind.by_date())).select("*", each).select("*", "d.n", "d.to")
    return rows.where((F.col("date") <= F.col("to")) & (F.col("__next").isNull() | (F.col("__next") > F.col("to"))))


def pullback_days(bars: DataFrame, days: list[str], p: Pullback, period: Column | None = None) -> DataFrame:
    """(symbol, n, to) where the bar at hand on a day does not rule out a signal of pullback: its band, the fast average, and an average that does not fall.

    bars are daily ones without nulls; p works on bars of ``period`` (none: days), of which the last is as of the day.
    Windows decide with some slack which histories are looked at; pullback itself decides on them.
    """
    own = bars.withColumn("period", F.col("date") if period is None else period)
    inside = Window.partitionBy("symbol", "period").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    now = _last_bars(own.select("symbol", "period", "date", "close", F.min("low").over(inside).alias("low")), days)
    w = Window.partitionBy("symbol").orderBy("period")
    sums = {f"{f}_{k}": getattr(F, f)("close").over(w.rowsBetween(1 - k, -1)) for f in ("sum", "count") for k in (p.average, 5)}
    done = own.groupBy("symbol", "period").agg(F.max_by("close", "date").alias("close")).withColumns({**sums, "old": F.avg("close").over(w.rowsBetween(-p.average, -1))}).drop("close")
    average, fast = ((F.coalesce(f"sum_{k}", F.lit(0.0)) + F.col("close")) / (F.col(f"count_{k}") + 1) for k in (p.average, 5))
    rows = now.join(done, ["symbol", "period"]).withColumns({"average": average, "fast": fast})
    low, mean = F.col("low"), F.col("average")
    near = (low >= p.low * mean - SLACK * mean) & (low <= p.high * mean + SLACK * mean) & (F.col("fast") > mean - SLACK * mean) & (mean >= F.col("old") - 0.02 - SLACK * mean)
    return rows.where(near).select("symbol", "n", "to")


def breakout_days(bars: DataFrame, days: list[str]) -> DataFrame:
    """(symbol, n, to) where the last bar on a day does not rule out a signal of breakout: a higher high on more than the double volume, of 60 bars."""
    rows = bars.withColumns({"before": ind.lag("high"), "mean": ind.mean("volume", 60), "bars": F.count("*").over(ind.over(60))})
    return _last_bars(rows, days).where((F.col("bars") == 60) & (F.col("high") > F.col("before")) & (F.col("volume") > (2 - SLACK) * F.col("mean"))).select("symbol", "n", "to")


#: what one grouped pass evaluates: name, time frame, and the signal from (frames by name, options)
PASSES = {
    DAILY.name: ("Daily", lambda f, **o: pullback_signal(f["daily"], f["weekly"], DAILY)),
    "ChanBreakout": ("Daily", lambda f, **o: breakout_signal(f["daily"], **o)),
    WEEKLY.name: ("Weekly", lambda f, **o: pullback_signal(f["weekly"], f["monthly"], WEEKLY)),
    MONTHLY.name: ("Monthly", lambda f, **o: pullback_signal(f["monthly"], f["monthly"], MONTHLY)),
}


def one_pass(tagged: DataFrame, wanted: dict[str, dict]) -> DataFrame:
    """SIGNALS rows of the wanted ones of PASSES (name: options), all from one grouped pass over PRICED bars with their ``frame``.

    A strategy that fails on a symbol leaves an ERROR row there, and the others go on.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        given, out = {name: pdf[pdf["frame"] == name] for name in ("daily", "weekly", "monthly")}, []
        for name, options in wanted.items():
            timeframe, signal = PASSES[name]
            own = given[timeframe.lower()]
            try:
                row = signal(given, **options) if len(own) else None
            except Exception as error:
                row = _failed(own, name, timeframe, error)
            out += [row] if row else []
        return pd.DataFrame(out, columns=NAMES)

    return tagged.select("frame", *PRICED).groupBy("symbol").applyInPandas(run, SIGNALS)


@dataclass(frozen=True)
class Account:
    cash: float = 1_000_000.0
    share: float = 0.2
    lot: int = 100
    rate: float = 0.0002
    least: float = 5.0
    slip: float = 0.001


def commission(size: float, price: float, a: Account = Account()) -> float:
    return max(abs(size) * price * a.rate, a.least)


TRADES = "symbol long, seq int, date date, action string, size double, price double, fee double, cash double, equity double, profit double"
EQUITY = "symbol long, date date, equity double"


def weekly_mean(day: pd.Series, close: np.ndarray, n: int = 30) -> np.ndarray:
    """At each bar the mean of the closes of the last n ISO weeks, the current one with its close so far; null before n weeks."""
    iso = pd.to_datetime(day).dt.isocalendar()
    week = (iso["year"] * 100 + iso["week"]).to_numpy()
    last = np.r_[week[1:] != week[:-1], True]
    ends = close[last]
    before = np.r_[0, np.cumsum(last[:-1])]  # completed weeks before each bar
    total = np.r_[0, np.cumsum(ends)]
    return np.where(before >= n - 1, (total[before] - total[np.maximum(0, before - n + 1)] + close) / n, np.nan)


class _Run:
    """One symbol's simulation, bar by bar; see backtest."""

    def __init__(self, pdf: pd.DataFrame, account: Account, peak_ratio: float, gain: float, lookback: int):
        self.pdf = pdf = pdf.dropna(subset=["open", "high", "low", "close"]).sort_values("date", ignore_index=True)
        self.account, self.x = account, _columns(pdf)
        x = self.x
        self.slow = pd.Series(x["close"]).rolling(30).mean().to_numpy()
        self.fast = pd.Series(x["close"]).rolling(5).mean().to_numpy()
        self.wild, self.week = atr(x["high"], x["low"], x["close"]), weekly_mean(pdf["date"], x["close"])
        m = chan.merge_p(*(x[c].tolist() for c in ("high", "low", "open", "close")))
        fractals = chan.fractals_p(m)
        ready = lambda k: m.row[min(k + 1, len(m.row) - 1)]  # known one merged bar later
        self.strokes = [(ready(b[0]), b[1] == chan.TOP, m.at[b[0]], m.low[b[0]]) for _, b in chan.strokes_p(m, fractals, chan.RULES["backtest"])]
        self.bottoms = [(ready(k), m.at[k]) for k, kind in fractals if kind != chan.TOP]
        self.cash, self.size, self.cost, self.trades = account.cash, 0.0, 0.0, []
        self.equity = np.full(len(pdf), account.cash)
        self._go(peak_ratio, gain, lookback)

    def trade(self, i: int, action: str, amount: float, price: float) -> None:
        paid = price * (1 + self.account.slip if amount > 0 else 1 - self.account.slip)
        fee = commission(amount, paid, self.account)
        profit = 0.0 if amount > 0 else -amount * (paid - self.cost) - fee
        self.cash -= amount * paid + fee
        self.cost = paid if amount > 0 else self.cost
        self.size += amount
        self.trades.append((self.pdf["symbol"].iloc[0], len(self.trades), self.pdf["date"].iloc[i], action, amount, paid, fee, self.cash, self.cash + self.size * self.x["close"][i], profit))

    def gained(self, at: int, gain: float) -> bool:
        lo = max(0, at - 29)
        least = self.x["low"][lo : at + 1].min()
        return least > 0 and self.x["high"][lo : at + 1].max() / least > gain

    def _go(self, peak_ratio: float, gain: float, lookback: int) -> None:
        high, low, close = self.x["high"], self.x["low"], self.x["close"]
        peaks, broken, k, candidate = [], False, 0, None
        for i in range(len(close)):
            while k < len(self.strokes) and self.strokes[k][0] <= i:
                _, up, at, price = self.strokes[k]
                if up and high[at] > peak_ratio * self.slow[at]:
                    peaks.append(at)
                elif not up:
                    broken = price < 0.95 * self.slow[at]  # a missing average breaks nothing
                k += 1
            if broken:
                candidate = None
            else:
                seen = [j for j in peaks if j > i - lookback] + [i] * bool(high[i] > peak_ratio * self.slow[i])
                best = max(seen, key=lambda j: high[j], default=None)
                if best is not None and (candidate is None or high[best] > high[candidate]):
                    candidate = best
            if self.size:
                self.leave(i)
            elif candidate is not None and self.gained(candidate, gain) and close[i] < high[candidate]:
                self.enter(i, high[candidate])
            self.equity[i] = self.cash + self.size * close[i]

    def enter(self, i: int, peak: float) -> None:
        close, low, slow, fast = self.x["close"][i], self.x["low"][i], self.slow, self.fast
        if not (0.97 * slow[i] <= low <= 1.05 * slow[i] and close > self.week[i] and fast[i] > slow[i] and i and round(slow[i], 2) >= round(slow[i - 1], 2)):
            return
        a = self.account
        amount = math.floor(min(a.share * self.cash, self.cash) / (close * (1 + a.slip)) / a.lot) * a.lot
        if amount:
            self.trade(i, "buy", amount, close)
            self.entry, self.first, self.peak, self.top, self.stop, self.bottom, self.sold = i, amount, peak, -math.inf, math.nan, math.nan, {}

    def leave(self, i: int) -> None:
        high, low, close, slow, fast, wild, lot = self.x["high"][i], self.x["low"][i], self.x["close"][i], self.slow, self.fast, self.wild[i], self.account.lot
        if math.isnan(self.bottom) and i > self.entry + 3:
            self.bottom = next((self.x["low"][at] for known, at in self.bottoms if at > self.entry and known <= i), math.nan)
        guard = slow[i] if math.isnan(self.week[i]) else self.week[i]
        self.top = max(self.top, high)
        if close < 0.95 * guard:
            return self.trade(i, "stop_average", -self.size, close)
        if wild > 0:
            stop = self.top - 2 * wild
            stop = stop if math.isnan(self.bottom) else max(stop, self.bottom - 0.1 * wild)
            self.stop = stop if math.isnan(self.stop) else max(stop, self.stop)
            if low < self.stop:
                return self.trade(i, "stop_trail", -self.size, close)
        if fast[i] < slow[i] and fast[i - 1] >= slow[i - 1]:
            return self.trade(i, "dead_cross", -self.size, close)
        half = (self.peak + self.bottom) / 2
        third = math.floor(self.first / 3 / lot) * lot
        if "half" not in self.sold and high >= half and 0 < third <= self.size:
            self.sold["half"] = third
            return self.trade(i, "target_half", -third, half)
        rest = min(max(0, math.floor(self.first / 2 / lot) * lot - self.sold.get("half", 0)), self.size)
        if "peak" not in self.sold and high >= self.peak and rest > 0:
            self.sold["peak"] = rest
            self.trade(i, "target_peak", -rest, self.peak)


def _simulate(bars: DataFrame, schema: str, rows, account: Account, peak_ratio: float, gain: float, lookback: int) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(rows(_Run(pdf, account, peak_ratio, gain, lookback)), columns=names)

    return bars.select("symbol", "date", "open", "high", "low", "close", "volume").groupBy("symbol").applyInPandas(run, schema)


def backtest(bars: DataFrame, account: Account = Account(), peak_ratio: float = 1.30, gain: float = 1.2, lookback: int = 100) -> DataFrame:
    """Trades of the pullback rule, bar by bar with one account a symbol; orders are filled on the bar that gives them.

    Candidate: the highest of the ends of up-strokes (backtest rule) of the last ``lookback`` bars and of the bars
    themselves with a high over peak_ratio * MA30, unless the last down-stroke ended more than 5 % under its MA30.
    Entry: the candidate's 30 bars gained enough; close under it and over the 30-week mean; low in 0.97-1.05 of MA30,
    MA5 over MA30, MA30 not falling.  Exits in order: close 5 % under the 30-week mean (MA30 while there is none); low
    under a stop that only rises, two ATR under the highest high since entry and at least 0.1 ATR under the first
    bottom fractal after entry; MA5 crosses under MA30.  Targets, filled at their price: half way from that fractal to
    the peak sells a third, the peak sells up to half of the first size together with it.
    """
    return _simulate(bars, TRADES, lambda r: r.trades, account, peak_ratio, gain, lookback)


def daily_equity(bars: DataFrame, account: Account = Account(), peak_ratio: float = 1.30, gain: float = 1.2, lookback: int = 100) -> DataFrame:
    """(symbol, date, equity) of the backtest at every close."""
    return _simulate(bars, EQUITY, lambda r: [(s, d, e) for s, d, e in zip(r.pdf["symbol"], r.pdf["date"], r.equity)], account, peak_ratio, gain, lookback)


MARKED = "symbol long, date date, action string, price double, peak double, low double"


def _centred(x: np.ndarray, best) -> tuple[np.ndarray, np.ndarray]:
    """Where a value is the best of the two before and the two (one) after it, with itself."""
    s = pd.Series(x)
    before = getattr(s.rolling(3, min_periods=1), best)().to_numpy()
    after = lambda n: getattr(s[::-1].rolling(n, min_periods=1), best)().to_numpy()[::-1]
    pick = np.maximum if best == "max" else np.minimum
    return x == pick(before, after(3)), x == pick(before, after(2))


def enhanced_marks(high, low, close, volume) -> tuple[list[tuple[int, float, float]], list[tuple[int, str, float]]]:
    """([(bar, peak, recent low) of buy marks], [(bar, rule, price) of sells]) of one symbol's bars; see enhanced."""
    n = len(close)
    ma5, ma30 = (pd.Series(close).rolling(k).mean().round(2).to_numpy() for k in (5, 30))
    slope = sum(c * np.r_[np.full(4 - k, np.nan), ma30[: n - 4 + k]] for k, c in enumerate((-0.2, -0.1, 0.0, 0.1, 0.2)) if c) if n > 4 else np.full(n, np.nan)
    wild = atr(high, low, close)
    tops, near_tops = _centred(high, "max")
    lows, near_lows = _centred(low, "min")
    tall = (high >= 1.2 * ma30) & (np.arange(n) >= 33)
    peak_at = low_at = -1
    buys, sells, held = [], [], None
    for t in range(n):
        if t >= 2 and tops[t - 2] and tall[t - 2]:
            peak_at = t - 2
        if t >= 2 and lows[t - 2]:
            low_at = t - 2
        if held:
            rule = _sell(t, held, high, low, close, volume, ma5, ma30, wild)
            if rule:
                sells.append((t, rule, close[t]))
                held = held if rule in ("TP1", "TP2") else None
        if t < 78:
            continue
        peak = t - 1 if near_tops[t - 1] and tall[t - 1] else peak_at
        if peak < 0 or not (slope[t] >= -1e-6 and close[t] > ma30[t] and ma5[t] > ma30[t] > 1e-6 and (close[t] - ma30[t]) / ma30[t] <= 0.05):
            continue
        if t - peak < 5:
            recent = low[t - 1]
        else:
            at = t - 1 if near_lows[t - 1] else low_at
            recent = low[at] if at >= peak + 5 else low[peak + 1 : t + 1].min()
        buys.append((t, high[peak], recent))
        if not held:
            held = {"entry": close[t], "peak": high[peak], "low": recent, "top": -math.inf, "stop": math.nan, "hit": 0}
    return buys, sells


def _sell(t, held, high, low, close, volume, ma5, ma30, wild) -> str | None:
    """The first rule that sells at bar t."""
    held["top"] = max(held["top"], high[t])
    if wild[t] > 0:
        held["stop"] = np.fmax(held["stop"], held["top"] - 2 * wild[t])
    if close[t] < 0.97 * ma30[t] and volume[t - 1] > 0 and volume[t] >= 1.5 * volume[t - 1]:
        return "A"
    if ma5[t - 1] >= ma30[t - 1] and ma5[t] < ma30[t]:
        return "B"
    if low[t] < held["stop"]:
        return "C"
    targets = ((held["peak"] + held["low"]) / 2, held["peak"], held["peak"] + held["entry"] - held["low"])
    if high[t] >= targets[held["hit"]]:
        held["hit"] += 1
        return f"TP{held['hit']}"
    return None


def enhanced(bars: DataFrame) -> DataFrame:
    """MARKED rows: a BUY for every bar that the buy rule marks, and the sells of positions taken at such marks.

    Averages are full and rounded to cents.  Buy: a newest centred high (five bars, cut at the bar itself) of at least
    1.2 MA30 lies before, MA30 does not fall over five bars, MA5 over MA30, close at most 5 % over MA30.  The recent low
    is the newest centred low from the fifth bar after the peak on, else the lowest low after the peak, or the low of the
    bar before where the peak is fewer than five bars old.  A position is taken at the close of a mark while none is
    open, and sold by the first of: A close under 0.97 MA30 on 1.5 times the volume before, B MA5 crosses under MA30, C low
    under the highest high since entry less two ATR (it never falls), TP1 half way from low to peak, TP2 the peak, TP3 the
    peak plus entry less low; targets in that order, a third each, all others close it.
    """
    names = [c.split()[0] for c in MARKED.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["high", "low", "close", "volume"]).sort_values("date", ignore_index=True)
        x = {c: pdf[c].to_numpy(float) for c in ("high", "low", "close", "volume")}
        buys, sells = enhanced_marks(x["high"], x["low"], x["close"], x["volume"])
        rows = [(t, "BUY", x["close"][t], p, w) for t, p, w in buys] + [(t, rule, price, None, None) for t, rule, price in sells]
        return pd.DataFrame([(pdf["symbol"].iloc[0], pdf["date"].iloc[t], *rest) for t, *rest in rows], columns=names)

    return bars.select("symbol", "date", "high", "low", "close", "volume").groupBy("symbol").applyInPandas(run, MARKED)
