"""Queries of predicates, joins, top-k, sets and scalar functions (C, D, G, H, I)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom import functions as fn
from barloom.operators import bars as period
from barloom.operators.asof import as_of
from barloom.operators.strategies import ratio
from barloom.plans.catalog import query
from barloom.plans.market import DAY, MONTH, WEEK, resampled
from barloom.sources import daily_bars, disclosures, read, reports, stock_list


@query("c01_range_and_null", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 90000 AND o_orderdate IS NOT NULL AND o_orderpriority <> ''")
def c01(spark, d):
    return read(spark, d, "orders").where("o_orderstatus = 'F' and o_totalprice between 1000 and 90000 and o_orderdate is not null and o_orderpriority <> ''").select("o_orderkey", "o_custkey")


@query("c02_keyword_or", "SELECT doc_id FROM documents WHERE text ILIKE '%license%' OR text ILIKE '%tion%ing%'")
def c02(spark, d):
    keys = ["%license%", "%tion%ing%"]
    return read(spark, d, "documents").where(reduce(lambda a, b: a | b, [F.col("text").ilike(k) for k in keys])).select("doc_id")


@query("c03_keyword_not", "SELECT doc_id FROM documents WHERE NOT (text ILIKE '%the%' OR text ILIKE '%token%')")
def c03(spark, d):
    return read(spark, d, "documents").where(~(F.col("text").ilike("%the%") | F.col("text").ilike("%token%"))).select("doc_id")


@query("c04_keywords_by_recency", "SELECT id, symbol, ann_date FROM disc WHERE ((title ILIKE '%th%' AND ann_date >= DATE '2024-12-31' - INTERVAL 36 MONTH) OR (title ILIKE '%de%' AND ann_date >= DATE '2024-12-31' - 365)) AND NOT title ILIKE '%!!%' AND raw_content IS NOT NULL", "disc")
def c04(spark, d):
    asof = DAY("2024-12-31")
    title = F.col("title")
    recent = (title.ilike("%th%") & (F.col("ann_date") >= F.add_months(asof, -36))) | (title.ilike("%de%") & (F.col("ann_date") >= F.date_sub(asof, 365)))
    return disclosures(spark, d).where(recent & ~title.ilike("%!!%") & F.col("raw_content").isNotNull()).select("id", "symbol", "ann_date")


@query("c05_in_and_not_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def c05(spark, d):
    orders = read(spark, d, "orders")
    some, urgent = orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey")), orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, d, "customer").join(some, "c_custkey", "left_semi").join(urgent, "c_custkey", "left_anti").select("c_custkey")


@query("c06_annual_reports", "SELECT symbol, report_date FROM facts WHERE month(report_date) = 12 AND day(report_date) = 31", "reports")
def c06(spark, d):
    return reports(spark, d).where("report_type = 'benefit' and month(report_date) = 12 and dayofmonth(report_date) = 31").select("symbol", "report_date")


@query("c07_project_constants", "SELECT id, symbol, 'research' AS tag, CAST(NULL AS VARCHAR) AS notes FROM disc", "disc")
def c07(spark, d):
    return disclosures(spark, d).select("id", "symbol", F.lit("research").alias("tag"), F.lit(None).cast("string").alias("notes"))


@query("c08_type_dispatch", "SELECT id, CASE WHEN contains(raw_content, '|') THEN 'table' WHEN contains(raw_content, '!!') THEN 'annual' ELSE 'other' END AS kind FROM disc", "disc")
def c08(spark, d):
    text = F.col("raw_content")
    return disclosures(spark, d).select("id", F.when(text.contains("|"), "table").when(text.contains("!!"), "annual").otherwise("other").alias("kind"))


@query("c09_analysis_date", "SELECT event_id, CAST(CASE WHEN isodow(ts) = 6 THEN ts::DATE - 1 WHEN isodow(ts) = 7 THEN ts::DATE - 2 WHEN hour(ts) >= 16 THEN ts::DATE WHEN isodow(ts) = 1 THEN ts::DATE - 3 ELSE ts::DATE - 1 END AS DATE) AS analysis_date FROM events")
def c09(spark, d):
    return read(spark, d, "events").select("event_id", fn.analysis_date(F.col("ts")).alias("analysis_date"))


@query("d01_inner_join", "SELECT conv_id, turn, doc_id FROM conversations JOIN documents ON conv_id = doc_id WHERE role = 'user'")
def d01(spark, d):
    turns, docs = read(spark, d, "conversations").where("role = 'user'"), read(spark, d, "documents").select("doc_id")
    return turns.join(docs, turns.conv_id == docs.doc_id).select("conv_id", "turn", "doc_id")


@query("d02_left_join_parent", "SELECT c_custkey, n_name, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2")
def d02(spark, d):
    c, o, n = (read(spark, d, t) for t in ("customer", "orders", "nation"))
    counts = o.groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    return c.join(counts, c.c_custkey == counts.o_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left").select("c_custkey", "n_name", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("d03_docs_without_chunks", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT conv_id FROM conversations)")
def d03(spark, d):
    return read(spark, d, "documents").join(read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id")), "doc_id", "left_anti").select("doc_id")


@query("d04_new_urls", "SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def d04(spark, d):
    pages = read(spark, d, "pages").where("url is not null").select("page_id", "url")
    return pages.join(pages.where("page_id % 3 = 0").select("url"), "url", "left_anti").select("page_id", "url")


@query("d05_semi_join_events", "SELECT code, name FROM stocks WHERE code IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.09)", "stocks")
def d05(spark, d):
    hit = read(spark, d, "lineitem").where("l_returnflag = 'R' and l_discount > 0.09").select(F.col("l_suppkey").alias("code"))
    return stock_list(spark, d).join(hit, "code", "left_semi").select("code", "name")


ASKED = "SELECT o_orderkey, o_custkey % (SELECT count(*) FROM supplier) AS symbol, CAST(o_orderdate AS DATE) AS date FROM orders"


def asked(spark, d):
    n = F.broadcast(read(spark, d, "supplier").agg(F.count("*").alias("n")))  # one row
    return read(spark, d, "orders").crossJoin(n).select("o_orderkey", (F.col("o_custkey") % F.col("n")).alias("symbol"), F.to_date("o_orderdate").alias("date"))


@query("d06_price_as_of", f"WITH q AS ({ASKED}) SELECT q.o_orderkey, CASE WHEN q.date - b.date <= 7 THEN round(b.close, 6) END AS close FROM q ASOF LEFT JOIN bars b ON b.symbol = q.symbol AND b.date <= q.date", "bars")
def d06(spark, d):
    return as_of(asked(spark, d), daily_bars(spark, d), "symbol", "date", "close", 7).select("o_orderkey", F.round("close", 6).alias("close"))


@query("d07_reports_as_of", "SELECT symbol, report_date, round(revenue, 2) AS revenue FROM facts WHERE report_date <= DATE '1998-05-20' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY report_date DESC) <= 3", "reports")
def d07(spark, d):
    rn = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("report_date")))
    known = reports(spark, d).where("report_type = 'benefit' and report_date <= date'1998-05-20'").withColumn("rn", rn).where("rn <= 3")
    return known.select("symbol", "report_date", F.round(fn.lookup_number(F.col("data"), "营业总收入"), 2).alias("revenue"))


@query("d08_same_quarter_last_year", "SELECT a.symbol, a.report_date, round(b.revenue, 2) AS before FROM facts a JOIN facts b ON a.symbol = b.symbol AND year(b.report_date) = year(a.report_date) - 1 AND month(b.report_date) = month(a.report_date) AND day(b.report_date) = day(a.report_date)", "reports")
def d08(spark, d):
    rows = reports(spark, d).where("report_type = 'benefit'").select("symbol", "report_date", fn.lookup_number(F.col("data"), "营业总收入").alias("revenue"))
    before = rows.select("symbol", F.add_months("report_date", 12).alias("report_date"), F.dayofmonth("report_date").alias("dom"), F.round("revenue", 2).alias("before"))
    return rows.join(before, ["symbol", "report_date"]).where(F.dayofmonth("report_date") == F.col("dom")).select("symbol", "report_date", "before")


@query("d09_weekly_as_of_daily", f"WITH w AS ({resampled(WEEK)}) SELECT b.symbol, b.date, w.period AS week, round(w.close, 6) AS weekly FROM bars b ASOF LEFT JOIN w ON w.symbol = b.symbol AND w.period <= b.date", "bars")
def d09(spark, d):
    bars = daily_bars(spark, d)
    weeks = period.weekly(bars).select("symbol", "date", F.col("close").alias("weekly"))
    return as_of(bars.select("symbol", "date"), weeks, "symbol", "date", "weekly").select("symbol", "date", F.col("weekly_date").alias("week"), F.round("weekly", 6).alias("weekly"))


@query("d10_month_for_week", f"WITH w AS ({resampled(WEEK)}), m AS ({resampled(MONTH)}) SELECT w.symbol, w.period AS date, round(coalesce(same.close, early.close), 6) AS monthly FROM w LEFT JOIN m same ON same.symbol = w.symbol AND date_trunc('month', same.period) = date_trunc('month', w.period) ASOF LEFT JOIN m early ON early.symbol = w.symbol AND early.period < date_trunc('month', w.period)", "bars")
def d10(spark, d):
    bars = daily_bars(spark, d)
    weeks = period.weekly(bars).select("symbol", "date", F.trunc("date", "month").alias("month"))
    months = period.monthly(bars).select("symbol", "date", F.col("close").alias("monthly"))
    same = months.select("symbol", F.trunc("date", "month").alias("month"), F.col("monthly").alias("same"))
    early = as_of(weeks.select("symbol", F.col("date").alias("week"), F.date_sub("month", 1).alias("date")), months, "symbol", "date", "monthly")
    joined = early.withColumn("month", F.trunc("week", "month")).join(same, ["symbol", "month"], "left")
    return joined.select("symbol", F.col("week").alias("date"), F.round(F.coalesce("same", "monthly"), 6).alias("monthly"))


@query("d12_topic_by_bucket", "SELECT t.topic, b.bucket, count(*) AS n FROM disc JOIN (VALUES ('th'), ('de'), ('tion')) t(topic) ON contains(raw_content, topic) JOIN (VALUES (0, 0, 365), (1, 365, 1095), (2, 1095, 100000)) b(bucket, lo, hi) ON DATE '2024-12-31' - ann_date BETWEEN lo AND hi GROUP BY 1, 2", "disc")
def d12(spark, d):
    topics = F.explode(F.array(*[F.lit(x) for x in ("th", "de", "tion")]))
    age = F.datediff(DAY("2024-12-31"), "ann_date")
    docs = disclosures(spark, d).select("raw_content", age.alias("age"), topics.alias("topic")).where("contains(raw_content, topic)")
    buckets = F.filter(F.array(*[F.struct(F.lit(i).alias("bucket"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for i, a, b in ((0, 0, 365), (1, 365, 1095), (2, 1095, 100000))]), lambda b: F.col("age").between(b["lo"], b["hi"]))
    return docs.select("topic", F.explode(buckets).alias("b")).groupBy("topic", F.col("b.bucket").alias("bucket")).agg(F.count("*").alias("n"))


@query("g03_top_k_distance", "WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM q)), 5) AS distance FROM embeddings WHERE vec_id <> 0 ORDER BY 2, 1 LIMIT 10")
def g03(spark, d):
    from barloom.operators.retrieval import cosine_distance

    rows = read(spark, d, "embeddings").where("embedding is not null")
    target = F.broadcast(rows.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1))  # one row
    return rows.where("vec_id <> 0").crossJoin(target).select("vec_id", F.round(cosine_distance("embedding", "q"), 5).alias("distance")).orderBy("distance", "vec_id").limit(10)


@query("g04_offset_page", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def g04(spark, d):
    return read(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey").offset(40).limit(20)


@query("g05_max_by_object", "SELECT symbol, arg_max(date, (high, date)) AS date, round(max(high), 6) AS high FROM bars GROUP BY 1", "bars")
def g05(spark, d):
    return daily_bars(spark, d).groupBy("symbol").agg(F.max(F.struct("high", "date")).alias("m")).select("symbol", "m.date", F.round("m.high", 6).alias("high"))


@query("h01_union_keep_first", "SELECT url, id, src FROM (SELECT url, id, 0 AS src FROM disc WHERE id % 2 = 0 UNION ALL SELECT url, id + 5000000, 1 FROM disc WHERE id % 3 = 0) QUALIFY row_number() OVER (PARTITION BY url ORDER BY src, id) = 1", "disc")
def h01(spark, d):
    docs = disclosures(spark, d).select("url", "id")
    both = docs.where("id % 2 = 0").withColumn("src", F.lit(0)).unionByName(docs.where("id % 3 = 0").select("url", (F.col("id") + 5000000).alias("id")).withColumn("src", F.lit(1)), allowMissingColumns=True)
    return both.groupBy("url").agg(F.min(F.struct("src", "id")).alias("m")).select("url", "m.id", "m.src")


@query("h02_keep_last", "SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE) ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) = 1")
def h02(spark, d):
    rows = read(spark, d, "lineitem").withColumns({"symbol": F.col("l_suppkey"), "date": F.to_date("l_shipdate")})
    kept = period.keep_last(rows, ["symbol", "date"], "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return kept.select("symbol", "date", "l_orderkey", "l_linenumber", "l_quantity")


@query("h03_unique_points", "SELECT DISTINCT CAST(l_shipdate AS DATE) AS date, l_discount AS level FROM lineitem")
def h03(spark, d):
    return read(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date"), F.col("l_discount").alias("level")).distinct()


@query("h04_newest_plus_notes", "WITH a AS (SELECT symbol, id, 0 AS p, ann_date FROM disc WHERE tag = 'en' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ann_date DESC, id) <= 1), b AS (SELECT symbol, id, 1 AS p, ann_date FROM disc WHERE tag <> 'en' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ann_date DESC, id) <= 3) SELECT symbol, id FROM (SELECT * FROM a UNION ALL SELECT * FROM b) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY p, ann_date DESC, id) <= 3", "disc")
def h04(spark, d):
    w = Window.partitionBy("symbol").orderBy(F.desc("ann_date"), "id")
    docs = disclosures(spark, d).select("symbol", "id", "tag", "ann_date")
    a = docs.where("tag = 'en'").withColumn("r", F.row_number().over(w)).where("r <= 1").withColumn("p", F.lit(0))
    b = docs.where("tag <> 'en'").withColumn("r", F.row_number().over(w)).where("r <= 3").withColumn("p", F.lit(1))
    slot = F.row_number().over(Window.partitionBy("symbol").orderBy("p", F.desc("ann_date"), "id"))
    return a.union(b).withColumn("slot", slot).where("slot <= 3").select("symbol", "id")


@query("i01_number_parse", "SELECT symbol, report_date, round(revenue, 2) AS revenue, round(equity, 2) AS equity FROM facts", "reports")
def i01(spark, d):
    both = reports(spark, d).groupBy("symbol", "report_date").agg(F.max(F.when(F.col("report_type") == "benefit", F.col("data"))).alias("b"), F.max(F.when(F.col("report_type") == "debt", F.col("data"))).alias("e"))
    return both.select("symbol", "report_date", F.round(fn.lookup_number(F.col("b"), "营业总收入"), 2).alias("revenue"), F.round(fn.lookup_number(F.col("e"), "所有者权益合计"), 2).alias("equity"))


@query("i02_fuzzy_key", "SELECT symbol, report_date, round(profit, 2) AS profit FROM facts", "reports")
def i02(spark, d):
    renamed = F.replace("data", F.lit("净利润"), F.lit("归属净利润(元)"))
    return reports(spark, d).where("report_type = 'benefit'").select("symbol", "report_date", F.round(fn.lookup_number(renamed, "净利润"), 2).alias("profit"))


@query("i03_large_number", "SELECT o_orderkey, CASE WHEN abs(v) >= 1e8 THEN printf('%.2f亿', v / 1e8) WHEN abs(v) >= 1e4 THEN printf('%.2f万', v / 1e4) ELSE printf('%.2f', v) END AS shown FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * 256.0::DOUBLE AS v FROM orders)")
def i03(spark, d):
    return read(spark, d, "orders").select("o_orderkey", fn.large_number(F.floor("o_totalprice") * F.lit(256.0)).alias("shown"))


@query("i04_yes_no", "SELECT doc_id, CASE WHEN toxic IS NULL THEN '不适用' WHEN toxic = 1 THEN '是' ELSE '否' END AS shown FROM labels")
def i04(spark, d):
    return read(spark, d, "labels").select("doc_id", fn.yes_no(F.col("toxic") == 1).alias("shown"))


@query("i04_float_format", "SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_discount > 1e-9 THEN printf('%.2f', round(l_tax / l_discount, 2)) WHEN l_tax > 0.05 THEN 'Infinity' WHEN l_tax > 0.02 THEN '-Infinity' ELSE '' END AS shown FROM lineitem")
def i04f(spark, d):
    """Two decimals, Infinity with its sign, or nothing."""
    x = F.when(F.col("l_discount") > 1e-9, F.try_divide("l_tax", "l_discount")).when(F.col("l_tax") > 0.05, float("inf")).when(F.col("l_tax") > 0.02, float("-inf"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", ratio(x).alias("shown"))


@query("i06_safe_divide", "SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_discount) > 1e-9 THEN round(l_tax / l_discount, 6) END AS ratio, greatest(l_tax, l_discount) AS high, least(l_tax, l_discount) AS low FROM lineitem")
def i06(spark, d):
    ratio = F.when(F.abs("l_discount") > 1e-9, F.round(F.try_divide("l_tax", "l_discount"), 6))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ratio.alias("ratio"), F.greatest("l_tax", "l_discount").alias("high"), F.least("l_tax", "l_discount").alias("low"))


@query("i07_date_arithmetic", "SELECT o_orderkey, CAST(o_orderdate AS DATE) - 30 AS back, CAST(CAST(o_orderdate AS DATE) - INTERVAL 3 YEAR AS DATE) AS years, CAST(date_trunc('month', o_orderdate) AS DATE) AS first, weekofyear(o_orderdate) AS week FROM orders")
def i07(spark, d):
    day = F.to_date("o_orderdate")
    return read(spark, d, "orders").select("o_orderkey", F.date_sub(day, 30).alias("back"), F.add_months(day, -36).alias("years"), F.trunc(day, "month").alias("first"), F.weekofyear(day).cast("long").alias("week"))


@query("i08_mixed_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS parsed FROM orders")
def i08(spark, d):
    day = F.to_date("o_orderdate")
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format(day, "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format(day, "yyyyMMdd")).when(k == 2, F.date_format(day, "yyyy年MM月dd日")).otherwise("soon")
    return read(spark, d, "orders").select("o_orderkey", fn.mixed_date(text).alias("parsed"))


@query("i09_url_parameter", "SELECT id, regexp_extract(url, 'id=([0-9]+)', 1) AS key, regexp_extract(url, 't=([a-z]*)', 1) AS lang FROM disc", "disc")
def i09(spark, d):
    return disclosures(spark, d).select("id", F.parse_url("url", F.lit("QUERY"), F.lit("id")).alias("key"), F.parse_url("url", F.lit("QUERY"), F.lit("t")).alias("lang"))


@query("i09_document_url", "SELECT id, CASE WHEN id % 5 <> 0 AND id % 7 <> 0 THEN 'https://files.example/' || CAST(ann_date AS VARCHAR) || '/' || id || '.PDF' END AS file_url FROM disc", "disc")
def i09b(spark, d):
    """A file's address from the parameters of its page's; null where one is missing or the time is no date."""
    day = F.date_format("ann_date", "yyyy-MM-dd")
    time = F.when(F.col("id") % 7 == 0, F.lit("soon")).otherwise(F.concat(day, F.lit("%2000:00:00")))
    page = F.concat(F.lit("https://pages.example/d?announcementId="), F.col("id").cast("string"), F.when(F.col("id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("&announcementTime="), time)))
    return disclosures(spark, d).select("id", fn.document_url(page, "https://files.example").alias("file_url"))


@query("i10_numeral", "SELECT p_partkey, p_partkey % 10 + 1 AS n FROM part")
def i10(spark, d):
    text = F.concat(F.lit("第"), F.element_at(F.split(F.lit("一,二,三,四,五,六,七,八,九,十"), ","), (F.col("p_partkey") % 10 + 1).cast("int")), F.lit("节"))
    return read(spark, d, "part").select("p_partkey", fn.numeral(text).alias("n"))


@query("i11_regex_count", r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+ing')) AS n, length(regexp_replace(text, '[0-9]+', '#', 'g')) AS size FROM documents WHERE text IS NOT NULL")
def i11(spark, d):
    return read(spark, d, "documents").where("text is not null").select("doc_id", F.size(F.regexp_extract_all("text", F.lit("[A-Za-z]+ing"), F.lit(0))).cast("long").alias("n"), F.length(F.regexp_replace("text", "[0-9]+", "#")).cast("long").alias("size"))


@query("i12_recent_rows_text", "SELECT symbol, string_agg(strftime(date, '%Y-%m-%d') || ' ' || CAST(CAST(volume AS BIGINT) AS VARCHAR), chr(10) ORDER BY date) AS rows FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 5) GROUP BY 1", "bars")
def i12(spark, d):
    rn = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    tail = daily_bars(spark, d).withColumn("rn", rn).where("rn <= 5")
    line = F.concat_ws(" ", F.date_format("date", "yyyy-MM-dd"), F.col("volume").cast("long").cast("string"))
    rows = F.array_sort(F.collect_list(F.struct("date", line.alias("line"))))
    return tail.groupBy("symbol").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("rows"))


@query("i13_json_in_text", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def i13(spark, d):
    noisy = F.concat(F.lit("answer: "), F.col("props"), F.lit(" end"))
    found = F.regexp_extract(noisy, r"(?s)\{.*\}", 0)
    return read(spark, d, "events").select("event_id", F.from_json(found, "k long")["k"].alias("k"))


@query("i14_truncate", "SELECT doc_id, length(left(text, 4000)) AS n FROM documents WHERE text IS NOT NULL")
def i14(spark, d):
    return read(spark, d, "documents").where("text is not null").select("doc_id", F.length(F.substring("text", 1, 4000)).cast("long").alias("n"))


@query("i15_coerce_numbers", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE round(value, 2) END AS value FROM events")
def i15(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, F.lit("--")).otherwise(F.col("value").cast("string"))
    return read(spark, d, "events").select("event_id", F.round(text.try_cast("double"), 2).alias("value"))


@query("i16_all_of_list", "SELECT l_orderkey, l_linenumber, l_quantity > 10 AND l_quantity > 20 AS above_all, l_tax > 0.01 OR l_tax > 0.07 AS above_any FROM lineitem")
def i16(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.forall(F.array(F.lit(10), F.lit(20)), lambda x: F.col("l_quantity") > x).alias("above_all"), F.exists(F.array(F.lit(0.01), F.lit(0.07)), lambda x: F.col("l_tax") > x).alias("above_any"))
