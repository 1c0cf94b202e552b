"""As-of joins without a range join: both sides meet in one window, dealt once by the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, tolerance: int | None = None) -> DataFrame:
    """left with the last non-null value of right on or before its date, at most ``tolerance`` days old.

    Both have (key, at); the result adds value and value_date.
    """
    marked = right.where(F.col(value).isNotNull()).select(key, at, F.struct(F.col(at).alias("d"), F.col(value).alias("v")).alias("__seen"), F.lit(0).alias("__side"))
    rows = left.withColumn("__side", F.lit(1)).unionByName(marked, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__seen", F.last("__seen", ignorenulls=True).over(w)).where("__side = 1")
    near = F.lit(True) if tolerance is None else F.datediff(at, F.col("__seen.d")) <= tolerance
    return rows.withColumn(value, F.when(near, F.col("__seen.v"))).withColumn(f"{value}_date", F.when(near, F.col("__seen.d"))).drop("__seen", "__side")
