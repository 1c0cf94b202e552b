"""Point-in-time metrics of reports: each (symbol, signal_date) sees what was published up to its own date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom import functions as fn
from barloom.operators.asof import as_of

TINY = 1e-6
STATE = ("report_date", "revenue", "profit", "revenue_before", "profit_before", "annual_profit", "annuals", "good_annuals")


def states(reports: DataFrame) -> DataFrame:
    """Per symbol and benefit report (symbol, at, state): what is known from that day on.

    The state holds the report, the same quarter of the year before, the latest annual profit, how many of the last
    three annual reports there are and how many of them made a profit.  One exchange by symbol serves all windows.
    """
    benefit = reports.where("report_type = 'benefit'").select(
        "symbol", "report_date", fn.lookup_number(F.col("data"), "营业总收入").alias("revenue"), fn.lookup_number(F.col("data"), "净利润").alias("profit"),
        ((F.month("report_date") == 12) & (F.dayofmonth("report_date") == 31)).alias("annual"),
    )
    own = Window.partitionBy("symbol").orderBy("report_date")
    annual = Window.partitionBy("symbol", "annual").orderBy("report_date").rowsBetween(-2, 0)
    good = F.sum((F.coalesce("profit", F.lit(0.0)) > TINY).cast("int")).over(annual)
    rows = benefit.withColumn("year", F.when(F.col("annual"), F.struct(F.col("profit").alias("p"), F.count("*").over(annual).alias("n"), good.alias("good"))))
    rows = rows.withColumn("year", F.last("year", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    day = F.dayofmonth("report_date")
    before = benefit.select("symbol", F.add_months("report_date", 12).alias("report_date"), day.alias("dom"), F.col("revenue").alias("revenue_before"), F.col("profit").alias("profit_before"))
    rows = rows.join(before.where(F.dayofmonth("report_date") == F.col("dom")).drop("dom"), ["symbol", "report_date"], "left")
    state = F.struct(
        "report_date", "revenue", "profit", "revenue_before", "profit_before", F.col("year.p").alias("annual_profit"),
        F.coalesce("year.n", F.lit(0)).alias("annuals"), F.coalesce("year.good", F.lit(0)).alias("good_annuals"),
    )
    return rows.select("symbol", F.col("report_date").alias("at"), state.alias("state"))


def slots(reports: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per (symbol, signal_date) of wanted: the columns of STATE and equity as of that day; null where nothing was published.

    reports has symbol, report_type (benefit, debt), report_date and data.  States change at reports only, so a
    signal meets one of them in a window and no range join multiplies signals by reports.
    """
    debt = reports.where("report_type = 'debt'").select("symbol", F.col("report_date").alias("at"), F.struct(fn.lookup_number(F.col("data"), "所有者权益合计").alias("v")).alias("equity"))
    rows = as_of(wanted.withColumn("at", F.col("signal_date")), states(reports), "symbol", "at", "state")
    rows = as_of(rows, debt, "symbol", "at", "equity")
    return rows.select(*wanted.columns, *[F.col(f"state.{c}").alias(c) for c in STATE], F.col("equity.v").alias("equity"))


def growth(now: str, before: str, infinite: bool) -> Column:
    """(now - before) / |before|; where before is about zero null, or infinite for a positive profit."""
    rate = F.try_divide(F.col(now) - F.col(before), F.abs(before))
    return F.when(F.abs(before) > 1e-9, rate).when((F.col(now) > 1e-9) & F.col(before).isNotNull() & F.lit(infinite), F.lit(float("inf")))


def metrics(slots_: DataFrame, shares: DataFrame) -> DataFrame:
    """PE, PB, growth, PEG-like ratio and flags per (symbol, signal_date).

    slots_ comes from ``slots`` with the price of that day as ``close``; shares has (symbol, total_shares).
    """
    rows = slots_.join(shares, "symbol", "left")
    cap = F.when(F.col("total_shares") > 1e-9, F.col("total_shares") * F.col("close"))
    rows = rows.withColumn("cap", cap).withColumns({"revenue_yoy": growth("revenue", "revenue_before", False), "profit_yoy": growth("profit", "profit_before", True)})
    rows = rows.withColumns({
        "pe": F.when(F.col("annual_profit") > TINY, F.try_divide("cap", "annual_profit")),
        "pb": F.when(F.col("equity") > 0, F.try_divide("cap", "equity")).when((F.col("equity") == 0) & (F.col("cap") > 0), F.lit(float("inf"))),
    })
    infinite = F.col("profit_yoy") == float("inf")
    positive = F.when(infinite, F.col("revenue_yoy") > TINY).when(F.col("revenue_yoy").isNotNull() & F.col("profit_yoy").isNotNull(), (F.col("revenue_yoy") > TINY) & (F.col("profit_yoy") > TINY))
    peg = F.when((F.col("profit_yoy") > TINY) & ~infinite, F.try_divide(F.col("pe"), F.col("profit_yoy") * 100))
    three = F.when(F.coalesce("profit", F.lit(0.0)) <= TINY, False).when(F.col("annuals") < 3, None).otherwise(F.col("good_annuals") == 3)
    missing = F.filter(F.array(
        F.when(F.col("close").isNull(), "Missing price"), F.when(F.col("total_shares").isNull(), "Missing shares"),
        F.when(F.col("revenue_before").isNull(), "Missing reports for YoY growth"), F.when(F.col("annual_profit").isNull(), "Missing annual profit"),
    ), lambda x: x.isNotNull())
    return rows.select(
        "symbol", "signal_date", "report_date", fn.rounded(F.col("cap"), 2).alias("market_cap"), fn.rounded(F.col("pe"), 4).alias("pe"), (F.col("pe") < 30).alias("pe_lt_30"), fn.rounded(F.col("pb"), 4).alias("pb"),
        fn.rounded(F.col("revenue_yoy"), 4).alias("revenue_growth_yoy"), fn.rounded(F.col("profit_yoy"), 4).alias("profit_growth_yoy"), positive.alias("growth_positive"),
        fn.rounded(peg, 4).alias("peg_like_ratio"), (peg < 1).alias("peg_like_lt_1"), three.alias("net_profit_positive_3y_latest"),
        F.array_join(F.array_sort(F.array_distinct(missing)), "; ").alias("error_reason"),
    )


def analyse(signals: DataFrame, bars: DataFrame, reports: DataFrame, shares: DataFrame) -> DataFrame:
    """Metrics of the distinct (symbol, signal_date) of signals: reports and prices of other symbols are not read further."""
    wanted = signals.select("symbol", "signal_date").distinct()
    some = wanted.select("symbol").distinct()
    priced = as_of(wanted.withColumn("date", F.col("signal_date")), bars.join(some, "symbol", "left_semi"), "symbol", "date", "close", 7)
    return metrics(slots(reports.join(some, "symbol", "left_semi"), priced.select("symbol", "signal_date", "close")), shares)
