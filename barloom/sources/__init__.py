"""Tables of the data model, read from Parquet: column pruning and filters reach the scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom import functions as fn


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def daily_bars(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """symbol, date, open, high, low, close, volume, amount; one partial aggregation and one shuffle.

    open and close are the prices of the first and last trade in the order of (order, line, part, amount, quantity).  With
    ``tasks`` the trades are dealt to that many tasks before they are aggregated, so that no sort holds a whole split of the files.
    """
    trades = read(spark, sf_dir, "lineitem").where("l_quantity > 0 and l_shipdate is not null").select(
        F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").alias("at"), "l_quantity", "l_extendedprice",
    )
    trades = trades if tasks is None else trades.repartition(tasks, "symbol", "date")
    return trades.groupBy("symbol", "date").agg(
        F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"),
        F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("amount"),
    )


def last_day(spark: SparkSession, sf_dir: str):
    """The date of the last of daily_bars, from the trades themselves: one value."""
    return read(spark, sf_dir, "lineitem").where("l_quantity > 0 and l_shipdate is not null").agg(F.to_date(F.max("l_shipdate"))).first()[0]


def dealt_bars(spark: SparkSession, sf_dir: str, rows: int = 1 << 16) -> DataFrame:
    """daily_bars dealt by symbol to tasks of about ``rows`` trades each, however many there are: for long chains of windows, as each
    of their sorts holds what its task has got.  The number of trades comes from the files' footers.
    """
    trades, least = read(spark, sf_dir, "lineitem").count(), spark.sparkContext.defaultParallelism
    return daily_bars(spark, sf_dir, max(least, -(-trades // (4 * rows)))).repartition(max(least, -(-trades // rows)), "symbol")


def walk_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars on the days of daily_bars whose closes are a random walk: each day's amount gives a return of up to 6 % either way."""
    w = Window.partitionBy("symbol").orderBy("date")
    step = (F.round(F.col("amount") * 100).cast("long") % 2001 - 1000) / F.lit(1000.0) * 0.06
    rows = daily_bars(spark, sf_dir).withColumn("close", fn.rounded(100 * F.exp(F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0))), 2))
    rows = rows.withColumn("open", F.coalesce(F.lag("close").over(w), F.lit(100.0)))
    return rows.select("symbol", "date", "open", fn.rounded(F.greatest("open", "close") * 1.005, 6).alias("high"), fn.rounded(F.least("open", "close") * 0.995, 6).alias("low"), "close", "volume", "amount")


def load_bars(bars: DataFrame, symbol=None, start: str | None = None, end: str | None = None, tail: int | None = None) -> DataFrame:
    """Bars of a closed range of dates, or the last ``tail`` bars of each symbol, by date; of one symbol or of all.

    One of the two has to be asked for, and not both: ValueError.
    """
    ranged = start is not None or end is not None
    if ranged == (tail is not None):
        raise ValueError("ask for a range of dates or for the last bars, and not for both")
    rows = bars if symbol is None else bars.where(F.col("symbol") == symbol)
    for given, bound in ((start, F.col("date") >= F.lit(start).cast("date")), (end, F.col("date") <= F.lit(end).cast("date"))):
        rows = rows if given is None else rows.where(bound)
    if tail is not None:
        last = Window.partitionBy("symbol").orderBy(F.desc("date"))
        rows = rows.withColumn("__rank", F.row_number().over(last)).where(F.col("__rank") <= tail).drop("__rank")
    return rows.orderBy("symbol", "date")


def stock_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, name, area, industry of every supplier."""
    supplier, nation, region = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"), F.col("r_name").alias("area"), F.col("n_name").alias("industry")
    )


def disclosures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, symbol (source), tag (lang), ann_date, title, url, raw_content of every document."""
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("symbol"), F.col("lang").alias("tag"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 1826).cast("int")).alias("ann_date"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.concat(F.lit("http://host/a?id="), F.col("doc_id").cast("string"), F.lit("&t="), F.col("lang")).alias("url"),
        F.col("text").alias("raw_content"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly reports of nations (symbol) from orders: report_type benefit and debt, report_date, data as JSON text.

    Amounts are written with unit signs, as published reports have them.  Prices are added exactly: a sum of doubles that ends in
    half a unit would round by the order of the rows.
    """
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    sums = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .groupBy(F.col("c_nationkey").cast("long").alias("symbol"), F.last_day(F.add_months(F.date_trunc("quarter", "o_orderdate").cast("date"), 2)).alias("report_date"))
        .agg(F.round(fn.exact_sum(F.col("o_totalprice")), 0).alias("revenue"), F.count("*").alias("n"))
    )
    wan = F.format_string("%.4f万", F.col("revenue") / 10000)
    profit = F.format_string("%.2f", F.col("revenue") * (F.col("n") % 7 - 1) / 20)
    benefit = F.concat(F.lit('{"营业总收入":"'), wan, F.lit('","净利润":"'), profit, F.lit('"}'))
    equity = F.concat(F.lit('{"所有者权益合计":"'), F.format_string("%.8f亿", F.col("revenue") * (F.col("n") % 5 - 1) / 1e8), F.lit('"}'))
    kinds = F.array(F.struct(F.lit("benefit").alias("report_type"), benefit.alias("data")), F.struct(F.lit("debt").alias("report_type"), equity.alias("data")))
    return sums.select("symbol", "report_date", F.inline(kinds))


SQL = {
    "bars": """
bars AS (
  SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date,
         arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)) AS open,
         max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
         arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)) AS close,
         sum(l_quantity) AS volume, sum(l_extendedprice) AS amount
  FROM lineitem WHERE l_quantity > 0 AND l_shipdate IS NOT NULL GROUP BY 1, 2
)""",
    "walk": """
steps AS (SELECT symbol, date, volume, amount, round(100 * exp(sum((CAST(round(amount * 100) AS BIGINT) % 2001 - 1000) / 1000.0::DOUBLE * 0.06) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)), 2) AS close FROM bars0),
opened AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY date), 100.0) AS open FROM steps),
bars AS (SELECT symbol, date, open, round(greatest(open, close) * 1.005, 6) AS high, round(least(open, close) * 0.995, 6) AS low, close, volume, amount FROM opened)""",
    "stocks": """
stocks AS (
  SELECT s_suppkey AS code, s_name AS name, r_name AS area, n_name AS industry
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)""",
    "disc": """
disc AS (
  SELECT doc_id AS id, source AS symbol, lang AS tag, DATE '2020-01-01' + CAST(doc_id % 1826 AS INTEGER) AS ann_date,
         split_part(text, chr(10), 1) AS title, 'http://host/a?id=' || doc_id || '&t=' || lang AS url, text AS raw_content
  FROM documents
)""",
    "reports": """
sums AS (
  SELECT CAST(c_nationkey AS BIGINT) AS symbol, last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS report_date,
         round(sum(o_totalprice), 0) AS revenue, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
), reports AS (
  SELECT symbol, CAST(report_date AS DATE) AS report_date, revenue, n FROM sums
), facts AS (
  SELECT symbol, report_date, round(revenue / 10000, 4) * 10000 AS revenue, round(revenue * (n % 7 - 1) / 20, 2) AS profit,
         round(revenue * (n % 5 - 1) / 1e8, 8) * 1e8 AS equity
  FROM reports
)""",
}
#: the walk stands where the bars do, so that queries over bars read either
SQL["walk"] = SQL["bars"].replace("bars AS (", "bars0 AS (", 1) + "," + SQL["walk"]
