"""Indicators as Columns over one window a symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom import functions as fn


def by_date():
    """Rows of a symbol in the order of dates: one exchange and sort serves all windows over it."""
    return Window.partitionBy("symbol").orderBy("date")


def over(rows: int) -> Window:
    """The last ``rows`` rows with the current one."""
    return by_date().rowsBetween(-(rows - 1), 0)


def mean(column: str, n: int, full: bool = False, places: int | None = None) -> Column:
    """Mean of the last n rows; with full, null before n values are there."""
    out = F.avg(column).over(over(n))
    out = F.when(F.count(column).over(over(n)) == n, out) if full else out
    return out if places is None else fn.rounded(out, places)


def exact_mean(column: str, n: int, places: int) -> Column:
    """mean() in full windows by decimals of 8 places, so that halves of a cent always round up; where a value has none, mean() itself."""
    exact = F.col(column).try_cast("decimal(28,8)")
    total = F.sum(exact).over(over(n)).try_cast("decimal(28,8)")
    out = F.round(total / F.lit(n).cast("decimal(4,0)"), places).cast("double")
    return F.coalesce(F.when(F.count(exact).over(over(n)) == n, out), mean(column, n, True, places))


def lag(column: str | Column, n: int = 1) -> Column:
    return F.lag(column, n).over(by_date())


def slope(column: str, k: int) -> Column:
    """Least-squares slope over the last k rows by row number; null before k values are there."""
    return F.when(F.count(column).over(over(k)) == k, F.regr_slope(F.col(column), F.col("bar_idx")).over(over(k)))


def below_run(column: str, level: str, n: int = 3) -> Column:
    """n rows in a row below a level; nulls break the run."""
    flag = F.coalesce((F.col(column) < F.col(level)).cast("int"), F.lit(0))
    return F.sum(flag).over(over(n)) == n


def with_index(bars: DataFrame) -> DataFrame:
    return bars.withColumn("bar_idx", F.row_number().over(by_date()) - 1)
