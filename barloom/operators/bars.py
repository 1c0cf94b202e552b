"""Bars of longer periods and their upkeep; symbols are dealt once by (symbol, period) with partial aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom import functions as fn


def by_date():
    """Rows of a symbol in the order of dates: one exchange and sort serves all windows over it."""
    return Window.partitionBy("symbol").orderBy("date")


def resample(bars: DataFrame, period: Column, label: str = "date") -> DataFrame:
    """Bars by period: first open, highest high, lowest low, last close (nulls skipped), summed volume and amount."""
    known_open, known_close = F.when(F.col("open").isNotNull(), F.col("date")), F.when(F.col("close").isNotNull(), F.col("date"))
    return (
        bars.groupBy("symbol", period.alias("period"))
        .agg(F.min_by("open", known_open).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", known_close).alias("close"),
             F.sum("volume").alias("volume"), F.sum("amount").alias("amount"), F.max("date").alias("last"))
        .where("open is not null and close is not null").withColumnRenamed("period", label)
    )


def weekly(bars: DataFrame, before: Column | None = None) -> DataFrame:
    """Completed weeks (Saturday to Friday, labelled Friday) whose label lies before a date."""
    out = resample(bars if before is None else bars.where(F.col("date") < before), fn.week_friday(F.col("date")))
    return out if before is None else out.where(F.col("date") < before)


def monthly(bars: DataFrame, before: Column | None = None) -> DataFrame:
    """Completed months labelled by their last business day; weekend days after it count for the next month."""
    out = resample(bars if before is None else bars.where(F.col("date") < before), fn.business_month_end(F.col("date")))
    return out if before is None else out.where(F.col("date") < before)


def dynamic(bars: DataFrame, unit: str, processing: Column) -> DataFrame:
    """The unfinished week or month up to a date: one bar a symbol, open and close by position, dated that day."""
    inside = bars.where((F.col("date") <= processing) & (F.col("date") >= F.date_trunc(unit, processing).cast("date")))
    out = inside.groupBy("symbol").agg(
        F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"),
        F.sum("volume").alias("volume"), F.sum("amount").alias("amount"),
    )
    return out.where("open is not null and close is not null").withColumn("date", processing)


def spine(bars: DataFrame, unit: str, least: int = 0) -> DataFrame:
    """Weeks (Fridays) or months (month ends) of every symbol without gaps: empty periods have volume 0 and null prices.

    Each bar brings the empty periods up to the next one, so the bars are aggregated once.  Symbols with fewer than
    ``least`` daily rows have none.
    """
    period = fn.week_friday(F.col("date")) if unit == "week" else F.last_day("date")
    rows = bars if not least else bars.withColumn("__n", F.count("*").over(Window.partitionBy("symbol"))).where(F.col("__n") >= least).drop("__n")
    dense = resample(rows, period).drop("last").withColumn("next", F.lead("date").over(by_date()))
    if unit == "week":
        steps = F.sequence("date", F.date_sub("next", 7), F.expr("interval 7 days"))
    else:
        steps = F.transform(F.sequence(F.trunc("date", "month"), F.add_months(F.trunc("next", "month"), -1), F.expr("interval 1 month")), lambda x: F.last_day(x))
    each = dense.select("*", F.explode(F.when(F.col("next").isNull(), F.array("date")).otherwise(steps)).alias("at"))
    own = F.col("at") == F.col("date")
    prices = [F.when(own, F.col(c)).alias(c) for c in ("open", "high", "low", "close")]
    return each.select("symbol", F.col("at").alias("date"), *prices, *[F.when(own, F.col(c)).otherwise(0.0).alias(c) for c in ("volume", "amount")])


def rebuilt(bars: DataFrame, unit: str, processing: str, since: str | None = None) -> DataFrame:
    """All completed weeks or months before the day's period, and the unfinished one dated that day; since: of bars from then on."""
    day = F.lit(str(processing)).cast("date")
    some = bars.where(F.col("date") <= day) if since is None else bars.where(F.col("date").between(F.lit(str(since)).cast("date"), day))
    done = (weekly if unit == "week" else monthly)(some, F.date_trunc(unit, day).cast("date")).drop("last")
    return done.unionByName(dynamic(some, unit, day).select(done.columns))


def refresh(table, bars: DataFrame, unit: str, processing: str, days: int = 90) -> None:
    """Bring a table of periods up to date from the bars of the last ``days`` days: whole periods are made anew and replace the old ones."""
    day = F.lit(str(processing)).cast("date")
    first = F.date_trunc(unit, F.date_sub(day, days)).cast("date")
    first = first if unit == "month" else F.date_sub(first, 2)  # completed weeks begin on Saturday
    new = rebuilt(bars.where(F.col("date") >= first), unit, processing)
    kept = table.read().where(F.col("date") < first)
    table.reload(kept.unionByName(new.select(kept.columns)))


def change(bars: DataFrame, order: str | None = None) -> DataFrame:
    """Percent change of the close; of equal (symbol, date) rows the one that is last by ``order`` counts."""
    if order is not None:
        bars = keep_last(bars, ["symbol", "date"], order)
    return bars.withColumn("pct_change", fn.signed_round(F.try_divide(F.col("close"), F.lag("close").over(by_date())) * 100 - 100, 4))


def keep_last(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The whole last row by the order columns of every key."""
    last = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__rank", F.row_number().over(last)).where(F.col("__rank") == 1).drop("__rank")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new, and the rows of old whose keys it does not hold: whole rows are replaced."""
    return new.unionByName(old.join(new.select(keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def high_water_mark(dimension: DataFrame, facts: DataFrame, today: Column, default: str = "2010-01-01") -> DataFrame:
    """code, start: where each symbol's next load begins; symbols that are up to date are left out."""
    last = facts.groupBy("symbol").agg(F.max("date").alias("last"))
    start = F.coalesce(F.date_add("last", 1), F.col("list_date"), F.lit(default).cast("date"))
    return dimension.join(last, dimension["code"] == last["symbol"], "left").select("code", start.alias("start")).where(F.col("start") <= today)
