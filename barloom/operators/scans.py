"""Exponential means and what is built on them as windows: no Python, and no recursion from row to row.

An exponential mean is a sum of inputs that decay: y = sum of x_j * exp(L - L_j), where L adds up the logarithms of the
factors by which the rows let the past decay.  A symbol's rows fall into blocks within which L changes by SPAN.  Inside a
block the sum is a running sum of x_j * exp(L_0 - L_j), scaled back; of what lies before, only the last sum of the block
before counts: anything earlier has decayed by more than a double's precision.  So each block is a window of its own, however
long a symbol's history is, and one exchange by symbol serves all windows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators import indicators as ind

SPAN = 40.0  # exp(-40) < 2**-57

MACD = ("ema12", "ema26", "diff", "dea", "bar")
SEEDED = ("macd", "macd_signal", "macd_hist")
KINDS = (*MACD, "rsi", *SEEDED, "atr", "adx")


def so_far():
    return ind.by_date().rowsBetween(Window.unboundedPreceding, 0)


def decayed(rows: DataFrame, decay: Column, **inputs: Column) -> DataFrame:
    """rows with a column for each input: the sum of the inputs so far, each decayed by the rows after it.

    decay: by how much, as a logarithm, a row lets what came before it decay (0 or less; null: not at all).  Null inputs add
    nothing.  rows: symbol, date.
    """
    block = Window.partitionBy("symbol", "__block").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    before = ind.by_date().rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__sum", F.sum(F.coalesce(decay, F.lit(0.0))).over(so_far()))
    rows = rows.withColumns({f"__{c}": F.coalesce(x.cast("double"), F.lit(0.0)) for c, x in inputs.items()})
    rows = rows.withColumn("__block", F.floor(-F.col("__sum") / SPAN))
    rows = rows.withColumn("__off", F.col("__sum") - F.first("__sum").over(block))
    rows = rows.withColumns({f"__{c}": F.exp("__off") * F.sum(F.col(f"__{c}") * F.exp(-F.col("__off"))).over(block) for c in inputs})
    end = F.when(~F.lead("__block").over(ind.by_date()).eqNullSafe(F.col("__block")), F.struct("__sum", *[f"__{c}" for c in inputs]))
    rows = rows.withColumn("__end", end).withColumn("__end", F.last("__end", ignorenulls=True).over(before))
    faded = F.exp(F.col("__sum") - F.col("__end.__sum"))
    return rows.withColumns({c: F.col(f"__{c}") + F.coalesce(F.col(f"__end.__{c}") * faded, F.lit(0.0)) for c in inputs}).drop("__sum", "__block", "__off", "__end", *[f"__{c}" for c in inputs])


def ema(rows: DataFrame, alpha: float, **values: Column) -> DataFrame:
    """Exponential means that begin with the first value; all values are null in the same rows, which leave the means as they are.

    After a gap the past has decayed once more for each row of it, as the weights of the two stay alpha and (1 - alpha)**n.
    """
    known = next(iter(values.values())).isNotNull()
    at = F.when(known, F.col("__row"))
    rows = rows.withColumn("__row", F.row_number().over(ind.by_date()))
    rows = rows.withColumn("__was", F.max(at).over(ind.by_date().rowsBetween(Window.unboundedPreceding, -1)))
    old = F.pow(F.lit(1 - alpha), F.col("__row") - F.col("__was"))
    rows = rows.withColumn("__new", F.when(known, F.when(F.col("__was").isNull(), 1.0).otherwise(alpha / (old + alpha))))
    rows = decayed(rows, F.when(known & F.col("__was").isNotNull(), F.log(old / (old + alpha))), **{c: F.col("__new") * x for c, x in values.items()})
    begun = F.col("__was").isNotNull() | F.col("__new").isNotNull()
    return rows.withColumns({c: F.when(begun, F.col(c)) for c in values}).drop("__row", "__was", "__new")


def seeded_ema(rows: DataFrame, alpha: float, n: int, begin: int, **values: Column) -> DataFrame:
    """Exponential means whose first value, at row ``begin`` (from 0), is the mean of the n rows up to it; null before."""
    rows = rows.withColumns({f"__x_{c}": x for c, x in values.items()})
    seeds = {f"__s_{c}": F.avg(f"__x_{c}").over(ind.over(n)) for c in values}
    rows = ind.with_index(rows.withColumns(seeds))
    row = F.col("bar_idx")
    fed = {c: F.when(row == begin, F.col(f"__s_{c}")).when(row > begin, alpha * F.col(f"__x_{c}")) for c in values}
    rows = decayed(rows, F.when(row > begin, F.lit(math.log1p(-alpha))), **fed)
    return rows.withColumns({c: F.when(row >= begin, F.col(c)) for c in values}).drop("bar_idx", *[f"__{k}_{c}" for k in "xs" for c in values])


def true_range() -> Column:
    close = ind.lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - close), F.abs(F.col("low") - close))


def indicators(bars: DataFrame, wanted=KINDS) -> DataFrame:
    """symbol, date, high, low, close and the wanted ones of KINDS; what is not known yet is null."""
    rows = bars.select("symbol", "date", "high", "low", "close")
    want, close = set(wanted), F.col("close")
    if want & set(MACD):
        rows = ema(ema(rows, 2 / 13, ema12=close), 2 / 27, ema26=close).withColumn("diff", F.col("ema12") - F.col("ema26"))
        if want & {"dea", "bar"}:
            rows = ema(rows, 2 / 10, dea=F.col("diff")).withColumn("bar", 2 * (F.col("diff") - F.col("dea")))
    if "rsi" in want:
        rows = rows.withColumn("__move", close - ind.lag("close"))
        rows = ema(rows, 1 / 14, __up=F.greatest("__move", F.lit(0.0)) + 0 * F.col("__move"), __down=F.greatest(-F.col("__move"), F.lit(0.0)) + 0 * F.col("__move"))
        rows = rows.withColumn("rsi", 100 * F.try_divide(F.col("__up"), F.col("__up") + F.col("__down"))).drop("__move", "__up", "__down")
    if want & set(SEEDED):
        rows = seeded_ema(seeded_ema(rows, 2 / 13, 12, 25, __fast=close), 2 / 27, 26, 25, __slow=close).withColumn("__line", F.col("__fast") - F.col("__slow"))
        rows = seeded_ema(rows, 2 / 10, 9, 33, macd_signal=F.col("__line"))
        rows = rows.withColumn("macd", F.when(F.col("macd_signal").isNotNull(), F.col("__line"))).withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("__fast", "__slow", "__line")
    if "atr" in want:
        rows = seeded_ema(rows.withColumn("__range", true_range()), 1 / 14, 14, 14, atr=F.col("__range")).drop("__range")
    if "adx" in want:
        rows = _adx(rows)
    return rows.select("symbol", "date", "high", "low", "close", *wanted)


def _adx(rows: DataFrame, n: int = 14) -> DataFrame:
    """Clipped moves by exponential means that are divided by the sum of their weights, over the mean range; DX mean(n)."""
    rows = rows.withColumns({"__up": F.col("high") - ind.lag("high"), "__down": ind.lag("low") - F.col("low"), "__range": true_range()})
    known = F.col("__up").isNotNull()
    clipped = {c: F.when(F.col(c) > 0, F.col(c)).otherwise(0.0) for c in ("__up", "__down")}
    rows = decayed(rows, F.lit(math.log1p(-1 / n)), __u=F.when(known, clipped["__up"]), __d=F.when(known, clipped["__down"]), __w=F.when(known, 1.0))
    rows = rows.withColumn("__base", ind.mean("__range", n, True))
    plus, minus = (F.try_divide(100 * F.try_divide(F.col(c), F.col("__w")), F.col("__base")) for c in ("__u", "__d"))
    rows = rows.withColumn("__plus", plus).withColumn("__minus", minus)
    rows = rows.withColumn("__dx", 100 * F.try_divide(F.abs(F.col("__plus") - F.col("__minus")), F.col("__plus") + F.col("__minus")))
    return rows.withColumn("adx", ind.mean("__dx", n, True)).drop("__up", "__down", "__range", "__u", "__d", "__w", "__base", "__plus", "__minus", "__dx")
