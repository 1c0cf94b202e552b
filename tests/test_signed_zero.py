"""What rounds to zero from below is -0.0 in SQL, and so are the texts made of it; decimals have no such zero."""

import duckdb
from pyspark.sql import functions as F

from barloom import functions as fn
from barloom.operators import fundamentals, strategies
from barloom.plans import catalog, indicators


def test_zeros_keep_their_sign_as_in_sql(spark):
    values = [-0.00003, 0.00003, -0.00005, -0.0, 0.0, -1.5, float("inf"), float("-inf"), float("nan"), None]
    listed = ", ".join("null" if x is None else f"'{x}'::double" for x in values)
    want = [str(r[0]) for r in duckdb.sql(f"select round(x, 4) from (select unnest([{listed}]) x)").fetchall()]
    rows = spark.createDataFrame([(x,) for x in values], "x double").coalesce(1)
    assert catalog.QUERIES
    for rounded in (fn.rounded(F.col("x"), 4), fn.signed_round(F.col("x"), 4), indicators.r("x", 4)):
        assert [str(r[0]) for r in rows.select(rounded).collect()] == want
    assert want[0] == "-0.0" and str(rows.select(F.round("x", 4)).first()[0]) == "0.0"


def test_growth_and_its_text_keep_the_sign(spark):
    slots = spark.createDataFrame([(1, 1999990.0, 2000000.0)], "symbol long, revenue double, revenue_before double")
    rest = {c: F.lit(1.0) for c in ("profit", "profit_before", "annual_profit", "equity", "close")} | {c: F.lit(3) for c in ("annuals", "good_annuals")}
    slots = slots.withColumns(rest | {c: F.lit("1999-01-01").cast("date") for c in ("signal_date", "report_date")})
    found = fundamentals.metrics(slots, spark.createDataFrame([(1, 1000.0)], "symbol long, total_shares double"))
    row = found.select("revenue_growth_yoy", strategies.ratio(F.lit(-0.0012)).alias("text")).first()
    assert (str(row.revenue_growth_yoy), row.text) == ("-0.0", "-0.00")
