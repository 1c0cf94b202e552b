"""Queries of learning (S): logistic regression on momentum and volatility, and its report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.plans.catalog import query
from barloom.sources import daily_bars


def samples(bars: DataFrame) -> DataFrame:
    """One row a symbol and month: momentum and volatility of its closes, and whether the next month's last close is higher (label)."""
    by_date, month = Window.partitionBy("symbol").orderBy("date"), F.trunc("date", "month")
    moved = bars.withColumns({"ret": F.try_divide(F.col("close"), F.lag("close").over(by_date)) - 1, "month": month})
    rows = moved.groupBy("symbol", "month").agg(
        (F.try_divide(F.max_by("close", "date"), F.min_by("close", "date")) - 1).alias("momentum"), F.stddev_samp("ret").alias("volatility"), F.max_by("close", "date").alias("last"),
    )
    later = F.lead("last").over(Window.partitionBy("symbol").orderBy("month"))
    return rows.withColumn("label", (later > F.col("last")).cast("double")).drop("last").na.drop()


def report(predictions: DataFrame) -> DataFrame:
    """class, support, precision, recall and f1 of (label, prediction) rows, from the confusion matrix; 0 where nothing was predicted."""
    counts = predictions.groupBy("label", "prediction").agg(F.count("*").alias("n"))
    hit = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    real = counts.groupBy(F.col("label").alias("class")).agg(hit.alias("hit"), F.sum("n").alias("support"))
    said = counts.groupBy(F.col("prediction").alias("class")).agg(F.sum("n").alias("said"))
    out = real.join(said, "class", "left").withColumns({"precision": F.coalesce(F.try_divide("hit", "said"), F.lit(0.0)), "recall": F.try_divide("hit", "support")})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.select("class", "support", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), F.round(f1, 9).alias("f1"))


ASIDE = "pmod(symbol * 31 + datediff(month, date'1970-01-01'), 5) = 0"


@query("s01_report_of_predictions", """
WITH m AS (SELECT symbol, date, close, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret, CAST(date_trunc('month', date) AS DATE) AS month FROM bars),
g AS (SELECT symbol, month, arg_max(close, date) / arg_min(close, date) - 1 AS momentum, stddev_samp(ret) AS volatility, arg_max(close, date) AS last FROM m GROUP BY 1, 2),
l AS (SELECT *, lead(last) OVER (PARTITION BY symbol ORDER BY month) AS later FROM g),
p AS (SELECT CAST(later > last AS DOUBLE) AS label, CAST(momentum < 0 AS DOUBLE) AS prediction FROM l WHERE later IS NOT NULL AND volatility IS NOT NULL AND momentum IS NOT NULL),
c AS (SELECT k AS class, count(*) FILTER (label = k) AS support, count(*) FILTER (prediction = k) AS said, count(*) FILTER (label = k AND prediction = k) AS hit FROM p, (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) v(k) GROUP BY k),
r AS (SELECT class, support, CASE WHEN said > 0 THEN hit / said ELSE 0 END AS precision, hit / support AS recall FROM c WHERE support > 0)
SELECT class, CAST(support AS BIGINT) AS support, round(precision, 9) AS precision, round(recall, 9) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 9) AS f1 FROM r""", "bars")
def s01_rule(spark, d):
    """The report of a fixed rule's predictions: a fallen month is followed by a rise."""
    return report(samples(daily_bars(spark, d)).withColumn("prediction", (F.col("momentum") < 0).cast("double")))


@query("s01_logistic_report")
def s01(spark, d):
    """The report of a regression's predictions on the fifth of the rows that is put aside."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["momentum", "volatility"], outputCol="features").transform(samples(daily_bars(spark, d)))
    rows = rows.orderBy("symbol", "month")  # the fit sums rows in one order
    model = LogisticRegression(maxIter=30).fit(rows.where(f"not {ASIDE}"))
    return report(model.transform(rows.where(ASIDE)))
