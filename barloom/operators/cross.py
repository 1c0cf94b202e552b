"""Signals that windows express: multi-level crosses and the classic rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators import indicators as ind

AVERAGES = {"daily": (5, 10, 20, 30), "weekly": (5, 10, 20, 30), "monthly": (3, 5, 10, 12)}


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def multi_level_cross(bars: DataFrame, level: str, rising: str = "strict", volume: float | None = 1.5) -> DataFrame:
    """symbol, date, close where the close rises above all averages that it was not above before.

    rising: "strict", "flat" (not falling), "slope" (not falling and a slope over 4 bars of at least -1e-6) or
    "none", for the longest average.  volume: the least multiple of the bar before's volume.
    """
    spans = AVERAGES[level]
    rows = ind.with_index(bars).withColumns({f"ma{n}": ind.mean("close", n, True, 2) for n in spans})
    rows = rows.withColumns({f"p{n}": ind.lag(f"ma{n}") for n in spans}).withColumns({"pclose": ind.lag("close"), "pvolume": ind.lag("volume")})
    top = spans[-1]
    if rising == "slope":
        rows = rows.withColumn("slope", ind.slope(f"ma{top}", 4))
    rules = [F.col("close") > F.col(f"ma{n}") for n in spans] + [F.col("pclose") <= F.col(f"p{n}") for n in spans]
    if rising == "strict":
        rules.append(F.col(f"ma{top}") > F.col(f"p{top}"))
    elif rising != "none":
        rules.append(F.col(f"ma{top}") >= F.col(f"p{top}"))
        if rising == "slope":
            rules.append(F.col("slope") >= -1e-6)
    if volume is not None:
        rules.append((F.col("pvolume") > 1e-6) & (F.col("volume") >= volume * F.col("pvolume")))
    return rows.where(_all(rules)).select("symbol", "date", "close")


def older_cross(bars: DataFrame, level: str, flat: bool = False, volume: float | None = None, skip: int = 1, gate: float | None = None) -> DataFrame:
    """The cross of the older strategies: rows without a close, a volume or an average go first, then neighbours are compared.

    flat: the longest average must not fall.  The first ``skip`` rows left cannot signal.  gate: a symbol signals only if
    its longest average's slope over the last four rows left is at least this; with fewer rows it is not asked for.
    """
    spans = AVERAGES[level]
    top = f"ma{spans[-1]}"
    rows = bars.withColumns({f"ma{n}": ind.mean("close", n, True, 2) for n in spans}).where(_all([F.col(c).isNotNull() for c in ("close", "volume", *(f"ma{n}" for n in spans))]))
    rows = ind.with_index(rows).withColumns({f"p{n}": ind.lag(f"ma{n}") for n in spans}).withColumns({"pclose": ind.lag("close"), "pvolume": ind.lag("volume")})
    rules = [F.col("bar_idx") >= skip] + [(F.col("close") > F.col(f"ma{n}")) & (F.col("pclose") <= F.col(f"p{n}")) for n in spans]
    if flat:
        rules.append(F.col(top) >= F.col(f"p{spans[-1]}"))
    if volume is not None:
        rules.append((F.col("pvolume") > 1e-6) & (F.col("volume") >= volume * F.col("pvolume")))
    if gate is not None:
        whole = ind.by_date().rowsBetween(-(2**31) + 1, 2**31 - 1)
        rows = rows.withColumn("slope", ind.slope(top, 4)).withColumn("slope", F.last("slope").over(whole))
        rules.append(F.col("slope").isNull() | (F.round("slope", 9) >= gate))
    return rows.where(_all(rules)).select("symbol", "date", "close")


def golden_cross(bars: DataFrame, fast: int = 5, slow: int = 20) -> DataFrame:
    """Full averages only: the first row with both has nothing to compare with."""
    rows = bars.withColumns({"f": F.round(ind.mean("close", fast, True), 6), "s": F.round(ind.mean("close", slow, True), 6)}).where("s is not null")
    return rows.withColumns({"pf": ind.lag("f"), "ps": ind.lag("s")}).where("f > s and pf <= ps").select("symbol", "date")


def bullish(bars: DataFrame) -> DataFrame:
    rows = bars.withColumns({f"m{n}": F.round(ind.mean("close", n, True), 6) for n in (5, 10, 20)})
    return rows.where("m5 > m10 and m10 > m20").select("symbol", "date")


def turtle(bars: DataFrame, n: int = 20) -> DataFrame:
    """Close above the highest high of the n bars before."""
    w = ind.by_date().rowsBetween(-n, -1)
    rows = bars.withColumn("top", F.when(F.count("high").over(w) == n, F.max("high").over(w)))
    return rows.where("close > top").select("symbol", "date")


def bollinger(bars: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    """Close above the mean and ``width`` sample deviations of the last n bars."""
    band = F.round(ind.mean("close", n, True) + width * F.stddev_samp("close").over(ind.over(n)), 6)
    return bars.withColumn("band", band).where("round(close, 6) > band").select("symbol", "date")
