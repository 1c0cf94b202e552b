"""Queries of sources, upkeep and bars (A, B, E)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom import functions as fn
from barloom.operators import bars as ops
from barloom.plans.catalog import query
from barloom.sources import daily_bars, disclosures, files, load_bars, read, reports, stock_list
from barloom.sources.tables import Table, scratch

DAY = lambda s: F.lit(s).cast("date")
OHLC = ["open", "high", "low", "close", "volume", "amount"]


def rounded(df, columns, places=6):
    return df.select(*[F.round(c, places).alias(c) if c in columns else F.col(c) for c in df.columns])


R = "round(open,6) AS open, round(high,6) AS high, round(low,6) AS low, round(close,6) AS close, round(volume,6) AS volume, round(amount,6) AS amount"
WEEK = "CAST(date + CAST((12 - isodow(date)) % 7 AS INTEGER) AS DATE)"
#: last business day of the month of d, as SQL
BME = "CAST(last_day({d}) - CAST(greatest(0, isodow(last_day({d})) - 5) AS INTEGER) AS DATE)"
NEXT = "CAST(date_trunc('month', date) + INTERVAL 1 MONTH AS DATE)"
MONTH = f"CASE WHEN date > {BME.format(d='date')} THEN {BME.format(d=NEXT)} ELSE {BME.format(d='date')} END"


def resampled(period: str, source: str = "bars") -> str:
    return f"""SELECT symbol, {period} AS period, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close,
  sum(volume) AS volume, sum(amount) AS amount FROM {source} GROUP BY 1, 2"""


@query("a01_daily_range", f"SELECT symbol, date, {R} FROM bars WHERE symbol = 7 AND date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'", "bars")
def a01(spark, d):
    return rounded(load_bars(daily_bars(spark, d), 7, "1996-01-01", "1996-12-31").select("symbol", "date", *OHLC), OHLC)


@query("a02_daily_tail", f"SELECT symbol, date, {R} FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 30", "bars")
def a02(spark, d):
    return rounded(load_bars(daily_bars(spark, d), tail=30).select("symbol", "date", *OHLC), OHLC)


@query("a04_weekly_tail", f"WITH w AS ({resampled(WEEK)}) SELECT symbol, period AS date, {R} FROM w QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY period DESC) <= 10", "bars")
def a04(spark, d):
    w = Window.partitionBy("symbol").orderBy(F.desc("date"))
    return rounded(ops.weekly(daily_bars(spark, d)).withColumn("rn", F.row_number().over(w)).where("rn <= 10").select("symbol", "date", *OHLC), OHLC)


@query("a05_monthly_range", f"WITH w AS ({resampled(MONTH)}) SELECT symbol, period AS date, {R} FROM w WHERE period BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'", "bars")
def a05(spark, d):
    return rounded(ops.monthly(daily_bars(spark, d)).where("date between date'1997-01-01' and date'1998-12-31'").select("symbol", "date", *OHLC), OHLC)


@query("a06_typed_period_scan", "SELECT symbol, date, CAST(volume AS BIGINT) AS volume, round(close, 6) AS close FROM bars WHERE date BETWEEN DATE '1998-03-01' AND DATE '1998-03-31'", "bars")
def a06(spark, d):
    return daily_bars(spark, d).where("date between date'1998-03-01' and date'1998-03-31'").select("symbol", "date", F.col("volume").cast("long").alias("volume"), F.round("close", 6).alias("close"))


@query("a07_point_lookup", "SELECT symbol, date, round(close, 6) AS close FROM bars WHERE symbol = 3 AND date = (SELECT min(date) FROM bars WHERE symbol = 3)", "bars")
def a07(spark, d):
    mine = daily_bars(spark, d).where("symbol = 3")
    return mine.orderBy("date").limit(1).select("symbol", "date", F.round("close", 6).alias("close"))


@query("a08_stock_listing", "SELECT code, name, area, industry FROM stocks WHERE code IS NOT NULL AND name <> ''", "stocks")
def a08(spark, d):
    return stock_list(spark, d).where("code is not null and name <> ''")


@query("a09_latest_report", "SELECT symbol, max(report_date) AS report_date, round(arg_max(revenue, report_date), 2) AS revenue FROM facts GROUP BY symbol", "reports")
def a09(spark, d):
    benefit = reports(spark, d).where("report_type = 'benefit'")
    last = benefit.groupBy("symbol").agg(F.max("report_date").alias("report_date"), F.max_by("data", "report_date").alias("data"))
    return last.select("symbol", "report_date", F.round(fn.lookup_number(F.col("data"), "营业总收入"), 2).alias("revenue"))


@query("a10_latest_and_annual_reports", """
WITH k AS (SELECT symbol, report_date, revenue, row_number() OVER (PARTITION BY symbol ORDER BY report_date DESC) AS rn,
  month(report_date) = 12 AS annual, row_number() OVER (PARTITION BY symbol, month(report_date) = 12 ORDER BY report_date DESC) AS an FROM facts)
SELECT symbol, report_date, round(revenue, 2) AS revenue FROM k WHERE rn = 1 OR (annual AND an <= 3)""", "reports")
def a10(spark, d):
    benefit = reports(spark, d).where("report_type = 'benefit' and data is not null").withColumn("annual", (F.month("report_date") == 12) & (F.dayofmonth("report_date") == 31))
    rn = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("report_date")))
    an = F.row_number().over(Window.partitionBy("symbol", "annual").orderBy(F.desc("report_date")))
    kept = benefit.withColumns({"rn": rn, "an": an}).where("rn = 1 or (annual and an <= 3)").dropDuplicates(["symbol", "report_date"])
    return kept.select("symbol", "report_date", F.round(fn.lookup_number(F.col("data"), "营业总收入"), 2).alias("revenue"))


@query("a11_thousands_parse", "SELECT CAST(p_partkey AS VARCHAR) AS symbol, p_size AS size, round(p_retailprice * 1000, 2) AS price FROM part")
def a11(spark, d):
    """A CSV file with thousands separators, written here, and read with text symbols."""
    path = scratch(spark, "csv")
    grouped = F.format_number(F.col("p_retailprice") * 1000, 2)
    read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("symbol"), F.col("p_size").alias("size"), grouped.alias("price")).write.csv(path, header=True)
    return files.read_csv(spark, path, {"symbol": "string", "size": "int", "price": "double"}).withColumn("price", F.round("price", 2))


@query("a12_vendor_matrix", f"SELECT CAST(symbol AS VARCHAR) AS symbol, date, {R.replace('round(volume,6)', 'round(volume/100,6)').replace(', round(amount,6) AS amount', '')} FROM bars WHERE symbol IS NOT NULL", "bars")
def a12m(spark, d):
    """Each symbol's bars as a matrix of text, one row a field and one column a day, and back to rows."""
    rows = daily_bars(spark, d).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("date", *OHLC[:5]))).alias("r"))
    values = lambda c: F.transform("r", lambda x: x[c].cast("string"))
    matrix = F.array(*[values(c) for c in OHLC[:5]])
    vendor = rows.select(F.concat(F.col("symbol").cast("string"), F.lit(".SZ")).alias("code"), F.array(*[F.lit(c.upper()) for c in OHLC[:5]]).alias("fields"), F.transform("r", lambda x: x["date"]).alias("times"), matrix.alias("data"))
    return rounded(files.from_matrix(vendor, {c: c for c in OHLC[:5]}), OHLC[:5])


@query("a12_wide_to_long", "SELECT split_part(l_suppkey || '.SZ', '.', 1) AS symbol, field, round(value, 4) AS value FROM (SELECT l_suppkey, sum(l_quantity) / 100 AS volume, max(l_tax) AS tax, sum(l_discount) AS discount FROM lineitem GROUP BY 1) UNPIVOT (value FOR field IN (volume, tax, discount))")
def a12(spark, d):
    wide = read(spark, d, "lineitem").groupBy(F.concat(F.col("l_suppkey").cast("string"), F.lit(".SZ")).alias("code")).agg((F.sum("l_quantity") / 100).alias("volume"), F.max("l_tax").alias("tax"), F.sum("l_discount").alias("discount"))
    long = wide.unpivot(["code"], ["volume", "tax", "discount"], "field", "value")
    return long.select(F.split_part("code", F.lit("."), F.lit(1)).alias("symbol"), "field", F.round("value", 4).alias("value"))


@query("a13_rename_map", f"SELECT CAST(symbol AS VARCHAR) AS symbol, date, {R}, CAST(NULL AS DOUBLE) AS amplitude, CAST(NULL AS DOUBLE) AS pct_change, CAST(NULL AS DOUBLE) AS price_change, CAST(NULL AS DOUBLE) AS turnover FROM bars", "bars")
def a13(spark, d):
    """Bars under the localised headers of a vendor's table, mapped back; columns it lacks are null."""
    localised = {v: k for k, v in files.HEADERS.items()}
    vendor = daily_bars(spark, d).withColumnsRenamed(localised).withColumn("extra", F.lit(1))
    return rounded(files.from_headers(vendor), OHLC)


@query("a14_key_value_pivot", "SELECT s_suppkey AS symbol, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey * 1000 END AS total_shares, CASE WHEN s_suppkey % 3 <> 0 THEN round(s_acctbal, 2) END AS market_cap, CASE WHEN s_suppkey % 5 <> 0 THEN DATE '2000-01-01' + CAST(s_suppkey % 9000 AS INTEGER) END AS listing_date, CASE WHEN s_suppkey % 7 <> 0 THEN s_name END AS stock_name FROM supplier")
def a14(spark, d):
    """Sheets of (item, value) texts with tokens for what is missing, as typed records."""
    s = read(spark, d, "supplier")
    day = F.date_add(F.lit("2000-01-01").cast("date"), (F.col("s_suppkey") % 9000).cast("int"))
    tokens = [("总股本", 4, (F.col("s_suppkey") * 1000).cast("string"), "None"), ("总市值", 3, F.round("s_acctbal", 2).cast("string"), "-"), ("上市时间", 5, F.date_format(day, "yyyyMMdd"), "--"), ("股票简称", 7, F.col("s_name"), "nan")]
    items = F.array(*[F.struct(F.lit(name).alias("item"), F.when(F.col("s_suppkey") % n != 0, value).otherwise(none).alias("value")) for name, n, value, none in tokens])
    sheet = s.select(F.col("s_suppkey").alias("symbol"), F.inline(items))
    return files.from_sheet(sheet, {"总股本": ("total_shares", "long"), "总市值": ("market_cap", "double"), "上市时间": ("listing_date", "date"), "股票简称": ("stock_name", "string")})


@query("a15_fold_to_json", "SELECT s_suppkey AS symbol, round(s_acctbal, 2) AS acctbal, s_nationkey AS nation FROM supplier")
def a15(spark, d):
    folded = read(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"), F.to_json(F.struct("s_acctbal", "s_nationkey")).alias("data"))
    return folded.select("symbol", F.round(F.get_json_object("data", "$.s_acctbal").cast("double"), 2).alias("acctbal"), F.get_json_object("data", "$.s_nationkey").cast("int").alias("nation"))


@query("b01_append", "SELECT symbol, date, round(close, 6) AS close FROM bars", "bars")
def b01(spark, d):
    table, bars = Table(spark, scratch(spark, "append")), daily_bars(spark, d).select("symbol", "date", "close")
    for k in range(3):
        table.append(bars.where(F.pmod(F.col("symbol"), F.lit(3)) == k))
    return rounded(table.read(), ["close"])


@query("b03_upsert_returning", "SELECT o_orderkey, round(o_totalprice * 2, 2) AS o_totalprice FROM orders WHERE o_orderkey % 100 = 7")
def b03(spark, d):
    """The rows that an upsert wrote, as the table has them afterwards."""
    orders, table = read(spark, d, "orders").select("o_orderkey", "o_totalprice"), Table(spark, scratch(spark, "upsert"))
    table.append(orders.where("o_orderkey % 3 <> 1"))
    new = orders.where("o_orderkey % 100 = 7").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    return rounded(table.upsert(new, ["o_orderkey"]), ["o_totalprice"], 2)


@query("b04_truncate_and_reload", "SELECT code, name FROM stocks WHERE code % 2 = 0", "stocks")
def b04(spark, d):
    table, stocks = Table(spark, scratch(spark, "reload")), stock_list(spark, d).select("code", "name")
    table.append(stocks)
    table.reload(stocks.where("code % 2 = 0"))
    return table.read()


@query("b09_replace_chunks", "SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_order, CASE WHEN doc_id % 4 = 1 THEN 'new ' || line ELSE line END AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE doc_id % 4 <> 1 OR i <= 2")
def b09(spark, d):
    """Documents whose chunks are made anew lose all old ones, also where they now have fewer."""
    table = Table(spark, scratch(spark, "chunks"))
    lines = read(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_order", "line"))
    table.append(lines)
    table.replace(lines.where("doc_id % 4 = 1 and chunk_order < 2").withColumn("line", F.concat(F.lit("new "), "line")), ["doc_id"])
    return table.read()


@query("b02_upsert", """
SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, CASE WHEN n.o_orderkey IS NULL THEN round(o.o_totalprice, 2) ELSE round(n.o_totalprice, 2) END AS o_totalprice, CASE WHEN n.o_orderkey IS NULL THEN o.o_orderpriority END AS o_orderpriority
FROM (SELECT * FROM orders WHERE o_orderkey % 3 <> 1) o FULL JOIN (SELECT o_orderkey, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0) n ON n.o_orderkey = o.o_orderkey""")
def b02(spark, d):
    orders = read(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    old, new = orders.where("o_orderkey % 3 <> 1"), orders.where("o_orderkey % 2 = 0").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return ops.upsert(old, new, ["o_orderkey"]).withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("b05_reload_current_period", "SELECT symbol, date, round(CASE WHEN date_trunc('month', date) = (SELECT date_trunc('month', max(date)) FROM bars) THEN close * 2 ELSE close END, 6) AS close FROM bars", "bars")
def b05(spark, d):
    bars = daily_bars(spark, d).select("symbol", "date", "close")
    edge = bars.agg(F.trunc(F.max("date"), "month").alias("edge"))
    marked = bars.crossJoin(F.broadcast(edge))  # one row
    reloaded = marked.where("date >= edge").withColumn("close", F.col("close") * 2)
    return marked.where("date < edge").union(reloaded).select("symbol", "date", F.round("close", 6).alias("close"))


@query("b06_reload_last_day", "SELECT id, ann_date FROM disc WHERE ann_date < (SELECT max(ann_date) FROM disc) UNION ALL SELECT id + 1000000, ann_date FROM disc WHERE ann_date >= (SELECT max(ann_date) FROM disc)", "disc")
def b06(spark, d):
    docs = disclosures(spark, d).select("id", "ann_date")
    marked = docs.crossJoin(F.broadcast(docs.agg(F.max("ann_date").alias("last"))))  # one row
    return marked.where("ann_date < last").select("id", "ann_date").union(marked.where("ann_date >= last").select(F.col("id") + 1000000, "ann_date"))


@query("b07_refresh_symbols", "SELECT symbol, date, CASE WHEN symbol IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) THEN close * 2 ELSE close END AS close FROM bars", "bars")
def b07(spark, d):
    bars, events = daily_bars(spark, d).select("symbol", "date", "close"), read(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("symbol"))
    again = bars.join(events, "symbol", "left_semi").withColumn("close", F.col("close") * 2)
    return bars.join(events, "symbol", "left_anti").union(again)


@query("b08_high_water_mark", """
WITH dim AS (SELECT s_suppkey AS code, CASE WHEN s_suppkey % 2 = 0 THEN DATE '1994-01-01' END AS list_date FROM supplier), m AS (SELECT symbol, max(date) AS last FROM bars WHERE symbol % 5 <> 0 GROUP BY 1)
SELECT code, coalesce(last + 1, list_date, DATE '2010-01-01') AS start FROM dim LEFT JOIN m ON m.symbol = dim.code WHERE coalesce(last + 1, list_date, DATE '2010-01-01') <= DATE '2001-10-15'""", "bars")
def b08(spark, d):
    dim = read(spark, d, "supplier").select(F.col("s_suppkey").alias("code"), F.when(F.col("s_suppkey") % 2 == 0, DAY("1994-01-01")).alias("list_date"))
    return ops.high_water_mark(dim, daily_bars(spark, d).where("symbol % 5 <> 0"), DAY("2001-10-15"))


@query("b12_exchange_routing", "SELECT code, CASE left(code, 1) WHEN '6' THEN code || '.SH' WHEN '0' THEN code || '.SZ' WHEN '3' THEN code || '.SZ' WHEN '2' THEN code || '.SZ' WHEN '8' THEN code || '.BJ' WHEN '4' THEN code || '.BJ' END AS routed FROM (SELECT CAST(c_custkey AS VARCHAR) AS code FROM customer) WHERE left(code, 1) IN ('6','0','3','2','8','4')")
def b12(spark, d):
    code = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("code"))
    return code.select("code", fn.exchange_suffix(F.col("code")).alias("routed")).where("routed is not null")


@query("e01_weekly_resample", f"WITH w AS ({resampled(WEEK)}) SELECT symbol, period AS date, {R} FROM w", "bars")
def e01(spark, d):
    return rounded(ops.weekly(daily_bars(spark, d)).select("symbol", "date", *OHLC), OHLC)


@query("e01_weekly_before_boundary", f"WITH b AS (SELECT * FROM bars WHERE date < DATE '1998-07-01'), w AS ({resampled(WEEK, 'b')}) SELECT symbol, period AS date, {R} FROM w WHERE period < DATE '1998-07-01'", "bars")
def e01b(spark, d):
    return rounded(ops.weekly(daily_bars(spark, d), DAY("1998-07-01")).select("symbol", "date", *OHLC), OHLC)


@query("e02_monthly_resample", f"WITH w AS ({resampled(MONTH)}) SELECT symbol, period AS date, {R} FROM w", "bars")
def e02(spark, d):
    return rounded(ops.monthly(daily_bars(spark, d)).select("symbol", "date", *OHLC), OHLC)


@query("e03_dynamic_week", f"WITH b AS (SELECT * FROM bars WHERE date <= DATE '1998-07-15' AND date >= DATE '1998-07-13'), w AS ({resampled(repr('x'), 'b')}) SELECT symbol, DATE '1998-07-15' AS date, {R} FROM w", "bars")
def e03(spark, d):
    return rounded(ops.dynamic(daily_bars(spark, d), "week", DAY("1998-07-15")).select("symbol", "date", *OHLC), OHLC)


@query("e03_dynamic_month", f"WITH b AS (SELECT * FROM bars WHERE date <= DATE '1998-07-15' AND date >= DATE '1998-07-01'), w AS ({resampled(repr('x'), 'b')}) SELECT symbol, DATE '1998-07-15' AS date, {R} FROM w", "bars")
def e03m(spark, d):
    return rounded(ops.dynamic(daily_bars(spark, d), "month", DAY("1998-07-15")).select("symbol", "date", *OHLC), OHLC)


@query("e04_weekly_spine", f"""
WITH w AS ({resampled(WEEK)}), e AS (SELECT symbol, min(period) AS a, max(period) AS z FROM w GROUP BY 1), s AS (SELECT symbol, CAST(unnest(generate_series(a, z, INTERVAL 7 DAY)) AS DATE) AS date FROM e)
SELECT s.symbol, s.date, round(open,6) AS open, round(high,6) AS high, round(low,6) AS low, round(close,6) AS close, round(coalesce(volume,0),6) AS volume, round(coalesce(amount,0),6) AS amount FROM s LEFT JOIN w ON w.symbol = s.symbol AND w.period = s.date""", "bars")
def e04(spark, d):
    return rounded(ops.spine(daily_bars(spark, d), "week").select("symbol", "date", *OHLC), OHLC)


@query("e04_monthly_spine", f"""
WITH w AS ({resampled('last_day(date)')}), e AS (SELECT symbol, date_trunc('month', min(period)) AS a, date_trunc('month', max(period)) AS z FROM w GROUP BY 1), s AS (SELECT symbol, last_day(CAST(unnest(generate_series(a, z, INTERVAL 1 MONTH)) AS DATE)) AS date FROM e)
SELECT s.symbol, s.date, round(open,6) AS open, round(high,6) AS high, round(low,6) AS low, round(close,6) AS close, round(coalesce(volume,0),6) AS volume, round(coalesce(amount,0),6) AS amount FROM s LEFT JOIN w ON w.symbol = s.symbol AND w.period = s.date""", "bars")
def e04m(spark, d):
    return rounded(ops.spine(daily_bars(spark, d), "month").select("symbol", "date", *OHLC), OHLC)


@query("e05_iso_week_last_close", "SELECT symbol, CAST(date_trunc('week', date) AS DATE) AS week, round(arg_max(close, date), 6) AS close FROM bars GROUP BY 1, 2", "bars")
def e05(spark, d):
    return daily_bars(spark, d).groupBy("symbol", F.date_trunc("week", "date").cast("date").alias("week")).agg(F.round(F.max_by("close", "date"), 6).alias("close"))


@query("e04_weekly_spine_full", f"""
WITH k AS (SELECT symbol FROM bars GROUP BY 1 HAVING count(*) >= 520), b AS (SELECT * FROM bars SEMI JOIN k USING (symbol)), w AS ({resampled(WEEK, 'b')}), e AS (SELECT symbol, min(period) AS a, max(period) AS z FROM w GROUP BY 1), s AS (SELECT symbol, CAST(unnest(generate_series(a, z, INTERVAL 7 DAY)) AS DATE) AS date FROM e)
SELECT s.symbol, s.date, round(close,6) AS close, round(coalesce(volume,0),6) AS volume FROM s LEFT JOIN w ON w.symbol = s.symbol AND w.period = s.date""", "bars")
def e04f(spark, d):
    """Symbols with fewer daily rows than a minimum (here 520) have no longer bars."""
    return rounded(ops.spine(daily_bars(spark, d), "week", least=520).select("symbol", "date", "close", "volume"), ["close", "volume"])


SINCE, NOW = "2001-04-01", "2001-07-18"
REBUILT = f"""
b AS (SELECT * FROM bars WHERE date <= DATE '{NOW}'), done AS (SELECT * FROM b WHERE date < DATE '2001-07-16'), part AS (SELECT * FROM b WHERE date >= DATE '2001-07-16'),
w AS (SELECT * FROM ({resampled(WEEK, 'done')}) WHERE period < DATE '2001-07-16' UNION ALL SELECT symbol, DATE '{NOW}', arg_min(open, date), max(high), min(low), arg_max(close, date), sum(volume), sum(amount) FROM part GROUP BY 1)"""


@query("e06_full_rebuild", f"WITH {REBUILT.strip()} SELECT symbol, period AS date, {R} FROM w", "bars")
def e06(spark, d):
    """Weeks of all bars up to a day, the last one unfinished and dated that day."""
    return rounded(ops.rebuilt(daily_bars(spark, d), "week", NOW).select("symbol", "date", *OHLC), OHLC)


@query("e06_recent_update", f"WITH {REBUILT.strip()} SELECT symbol, period AS date, {R} FROM w", "bars")
def e06b(spark, d):
    """A table of weeks that is some months old, brought up to date from the bars of the last 90 days only."""
    bars, table = daily_bars(spark, d), Table(spark, scratch(spark, "weeks"))
    table.append(ops.rebuilt(bars, "week", "2001-06-15").select("symbol", "date", *OHLC))
    ops.refresh(table, bars, "week", NOW, days=90)
    return rounded(table.read().select("symbol", "date", *OHLC), OHLC)


@query("e07_percent_change", f"WITH w AS ({resampled(WEEK)}) SELECT symbol, period AS date, round(close / lag(close) OVER (PARTITION BY symbol ORDER BY period) * 100 - 100, 4) AS pct_change FROM w", "bars")
def e07(spark, d):
    weeks = ops.weekly(daily_bars(spark, d)).withColumn("loaded", F.lit(2))
    stale = weeks.where("pmod(symbol, 4) = 0").withColumns({"close": F.lit(0.0), "loaded": F.lit(1)})
    return ops.change(weeks.union(stale), "loaded").select("symbol", "date", "pct_change")


@query("e08_date_range_by_symbol", "SELECT symbol, min(date) AS first_date, max(date) AS last_date, count(*) AS n FROM bars GROUP BY 1", "bars")
def e08(spark, d):
    return daily_bars(spark, d).groupBy("symbol").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n"))


@query("e09_count_by_key", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1")
def e09(spark, d):
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))


@query("e10_price_summary", "SELECT symbol, round((arg_max(close, date) / arg_min(close, date) - 1) * 100, 4) AS change, round(max(high), 6) AS high, round(min(low), 6) AS low, round(avg(volume), 6) AS volume FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 60) GROUP BY 1", "bars")
def e10(spark, d):
    w = Window.partitionBy("symbol").orderBy(F.desc("date"))
    tail = daily_bars(spark, d).withColumn("rn", F.row_number().over(w)).where("rn <= 60")
    change = (F.try_divide(F.max_by("close", "date"), F.min_by("close", "date")) - 1) * 100
    return tail.groupBy("symbol").agg(fn.signed_round(change, 4).alias("change"), F.round(F.max("high"), 6).alias("high"), F.round(F.min("low"), 6).alias("low"), F.round(F.avg("volume"), 6).alias("volume"))


@query("e11_report_pivot", "SELECT symbol, metric, round(max(CASE WHEN year(report_date) = 1996 THEN v END), 2) AS y1996, round(max(CASE WHEN year(report_date) = 1997 THEN v END), 2) AS y1997 FROM (SELECT symbol, report_date, unnest(['revenue', 'profit']) AS metric, unnest([revenue, profit]) AS v FROM facts WHERE month(report_date) = 12) WHERE year(report_date) IN (1996, 1997) GROUP BY 1, 2", "reports")
def e11(spark, d):
    benefit = reports(spark, d).where("report_type = 'benefit' and month(report_date) = 12 and year(report_date) in (1996, 1997)")
    long = benefit.select("symbol", F.concat(F.lit("y"), F.year("report_date").cast("string")).alias("y"), F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), fn.lookup_number(F.col("data"), k).alias("v")) for m, k in (("revenue", "营业总收入"), ("profit", "净利润"))])))
    return long.groupBy("symbol", "metric").pivot("y", ["y1996", "y1997"]).agg(F.round(F.max("v"), 2))


@query("e12_momentum_quantile", """
WITH r AS (SELECT symbol, CASE WHEN arg_min(close, date) = 0 THEN 0 ELSE arg_max(close, date) / arg_min(close, date) - 1 END AS ret FROM bars WHERE date > DATE '2001-01-01' GROUP BY 1)
SELECT symbol, round(ret, 6) AS ret FROM r WHERE round(ret, 9) >= (SELECT quantile_cont(round(ret, 9), 0.7) FROM r)""", "bars")
def e12(spark, d):
    first, last = F.min_by("close", "date"), F.max_by("close", "date")
    r = daily_bars(spark, d).where("date > date'2001-01-01'").groupBy("symbol").agg(F.round(F.when(first == 0, 0.0).otherwise(F.try_divide(last, first) - 1), 9).alias("ret"))
    edge = F.broadcast(r.agg(F.percentile("ret", 0.7).alias("edge")))  # one row
    return r.crossJoin(edge).where("ret >= edge").select("symbol", fn.signed_round(F.col("ret"), 6).alias("ret"))


@query("e15_group_turns", "SELECT conv_id, string_agg(role || ':' || length(text), '|' ORDER BY turn, role, length(text)) AS outline FROM conversations WHERE text IS NOT NULL GROUP BY 1")
def e15(spark, d):
    turns = read(spark, d, "conversations").where("text is not null")
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("n"))))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda x: F.concat(x["role"], F.lit(":"), x["n"].cast("string"))), "|").alias("outline"))


@query("e16_outcome_tally", "SELECT sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS n_open, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS n_final, sum(CASE WHEN o_orderstatus NOT IN ('O','F') THEN 1 ELSE 0 END) AS n_other FROM orders")
def e16(spark, d):
    s = F.col("o_orderstatus")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return read(spark, d, "orders").agg(n(s == "O").alias("n_open"), n(s == "F").alias("n_final"), n(~s.isin("O", "F")).alias("n_other"))
