"""Sums that end in exactly half a unit: added as doubles they round by the order of the rows."""

import math
import random

from pyspark.sql import functions as F

from barloom.operators import indicators as ind
from barloom.sources import reports


def added(prices):
    total = 0.0
    for x in prices:
        total += x
    return total


def cent(x):
    return math.floor(x * 100 + 0.5)


def halves(n, unit, wrong):
    """Prices whose exact sum in cents is a multiple of ``unit`` and a half of it, and for which wrong(prices, cents) holds."""
    draw = random.Random(7)
    for _ in range(10_000):
        cents = [draw.randrange(10_000_000, 40_000_000) for _ in range(n)]
        cents[0] += (unit // 2 - sum(cents)) % unit
        prices = [x / 100 for x in cents]
        if wrong(prices, sum(cents)):
            return prices, sum(cents)
    raise AssertionError("no such prices")


def test_revenue_is_added_exactly(spark, tmp_path):
    prices, cents = halves(500, 100, lambda prices, cents: added(prices) < cents / 100)
    spark.createDataFrame([(1, 3)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    rows = spark.createDataFrame([(1, x) for x in prices], "o_custkey long, o_totalprice double").coalesce(1)
    rows.withColumn("o_orderdate", F.timestamp_seconds("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    got = reports(spark, str(tmp_path)).where("report_type = 'benefit'").select(F.get_json_object("data", "$.营业总收入")).first()[0]
    assert got == f"{(cents + 50) // 100 / 10000:.4f}万"


def test_mean_is_added_exactly(spark):
    for wrong in (lambda prices, cents: cent(added(prices) / 30) != cent(cents / 100 / 30), lambda prices, cents: cent(cents / 100 / 30) != (cents + 15) // 30):
        prices, cents = halves(30, 30, wrong)
        bars = spark.createDataFrame([(1, i, x) for i, x in enumerate(prices)], "symbol long, date int, close double").coalesce(1)
        last = bars.select("date", ind.exact_mean("close", 30, 2).alias("exact")).where("date = 29").first()
        assert last.exact == (cents + 15) // 30 / 100


def test_what_no_decimal_holds_is_still_added(spark):
    from barloom.functions import exact_sum

    rows = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("a", 1e25), ("b", float("nan")), ("b", 1.0), ("c", None), ("d", 0.1), ("d", 0.2), ("d", None)], "k string, x double")
    got = {r.k: r.x for r in rows.groupBy("k").agg(exact_sum(F.col("x")).alias("x")).collect()}
    assert (got["a"], got["c"], got["d"]) == (1e25, None, 0.3) and math.isnan(got["b"])
