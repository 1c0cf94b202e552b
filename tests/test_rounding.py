import duckdb
from pyspark.sql import functions as F

from barloom import functions as fn


def test_rounded_is_what_sql_rounds(spark):
    """Halves of a cent, as written, as a sum and as a quotient: F.round differs from SQL on some of them."""
    values = [x for i in range(5, 20_000, 10) for x in (i / 1000, i / 1000 + 3490.9, -(i * 7) / 7000, i / 3 * 0.003)]
    want = [r[0] for r in duckdb.sql(f"select round(x, 2) from (select unnest({values!r}::double[]) x)").fetchall()]
    rows = spark.createDataFrame([(n, x) for n, x in enumerate(values)], "n long, x double").select("n", fn.rounded(F.col("x"), 2).alias("ours"), F.round("x", 2).alias("theirs")).orderBy("n").collect()
    assert [r.ours for r in rows] == want
    assert [r.theirs for r in rows] != want
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "x double").select(fn.rounded(F.col("x"), 2)).collect()
    assert [str(r[0]) for r in odd] == ["nan", "inf", "None"]


def test_bars_are_dealt_by_the_number_of_trades(spark, sf):
    """A task's share of the bars has a bound that does not grow with the tables; windows by symbol add no exchange."""
    from barloom.operators import scans
    from barloom.sources import dealt_bars

    parts = dealt_bars(spark, sf, 100)
    assert parts.rdd.getNumPartitions() == -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 100)
    assert dealt_bars(spark, sf).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    plan = scans.indicators(parts, ["bar"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
