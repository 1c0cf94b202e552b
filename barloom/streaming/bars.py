"""Bars of event streams: the same aggregation for batch and stream, late data and upserts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators.bars import keep_last
from barloom.sources.tables import written


def event_bars(events: DataFrame, length: str = "1 day", late: str | None = "2 days") -> DataFrame:
    """OHLC of (event_type, window); open and close by (ts, event_id).  Null times or values take no part.

    In a stream the watermark bounds the state; in a batch it changes nothing.
    """
    rows = events.where("ts is not null and value is not null")
    kind = events.schema["ts"].dataType.simpleString()
    if late and events.isStreaming:  # watermarks need a timestamp with time zone
        rows = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    at = F.struct("ts", "event_id")
    return (
        rows.groupBy("event_type", F.window("ts", length).alias("w"))
        .agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("n"))
        .select("event_type", F.col("w.start").cast(kind).alias("start"), "open", "high", "low", "close", "n")
    )


def unique_events(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event_id once; in a stream repeats are known as long as the watermark holds them."""
    if not events.isStreaming:
        return events.dropDuplicates(["event_id"])
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    rows = events.where("ts is not null")
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


RUNNING = "user_id long, event_id long, total double"


def _running_rows(key, batches, state):
    held = state.get[0] if state.exists else 0.0
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    sums = held + rows["value"].fillna(0.0).cumsum()
    state.update((float(sums.iloc[-1]),))
    yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "total": sums})


def running_state(events: DataFrame) -> DataFrame:
    """(user_id, event_id, total): the sum of a user's values so far, carried from trigger to trigger of a stream.

    A user's events of one trigger are summed in the order of (ts, event_id); null values add nothing, rows without a
    user are one group of their own.  Over a table it is one window.
    """
    rows = events.select("user_id", "event_id", "ts", "value")
    if not events.isStreaming:
        w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
        return rows.select("user_id", "event_id", F.sum(F.coalesce("value", F.lit(0.0))).over(w).alias("total"))
    return rows.groupBy("user_id").applyInPandasWithState(_running_rows, RUNNING, "total double", "append", "NoTimeout")


class UpsertSink:
    """A foreachBatch function that keeps a Parquet table current: a batch's rows replace those of equal keys.

    The table is partitioned by a hash of the keys.  A batch is merged with the partitions that its keys fall into, and only
    these are overwritten; then (query, epoch) is recorded.  A batch whose epoch the record has is left out, and one that
    failed before it was recorded merges to the same rows again, so replays change nothing.  Epochs may be missing, and a
    query with a new checkpoint counts anew on the same table.  One writer at a time; no older versions are kept.

    Of rows of one batch with equal keys the last by ``order`` counts, or an arbitrary one; null keys are equal.  Columns
    that only some batches have are null elsewhere.
    """

    def __init__(self, path: str, keys: list[str], order: list[str] | None = None, partitions: int = 64, query: str | None = None):
        self.path, self.keys, self.order, self.partitions, self.query = path.rstrip("/"), keys, order or [], partitions, query

    def _fs(self, spark: SparkSession, below: str):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}")
        return at, at.getFileSystem(spark._jsc.hadoopConfiguration())

    def applied(self, spark: SparkSession, query: str) -> int:
        """The last recorded epoch of a query, -1 where there is none."""
        at, fs = self._fs(spark, f"applied/{query}")
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return max((int(x) for x in names if x.isdigit()), default=-1)

    def _record(self, spark: SparkSession, query: str, epoch: int) -> None:
        last = self.applied(spark, query)
        at, fs = self._fs(spark, f"applied/{query}/{epoch}")
        fs.create(at, True).close()
        if last >= 0:
            fs.delete(self._fs(spark, f"applied/{query}/{last}")[0], False)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.option("mergeSchema", "true").parquet(f"{self.path}/data").drop("__part")

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        query = self.query or spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        if epoch <= self.applied(spark, query):
            return
        dealt = F.pmod(F.xxhash64(*self.keys), F.lit(self.partitions)).cast("int")
        new = written(keep_last(batch, self.keys, *(self.order or self.keys)).withColumn("__part", dealt), "batch")
        touched = [r[0] for r in new.select("__part").distinct().collect()]  # at most ``partitions``
        if touched:
            at, fs = self._fs(spark, "data")
            merged = new
            if fs.exists(at):
                old = spark.read.option("mergeSchema", "true").parquet(f"{self.path}/data").where(F.col("__part").isin(touched))
                same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.keys]
                rest = old.alias("o").join(new.select(self.keys).alias("n"), same, "left_anti").select("o.*")
                merged = written(rest.unionByName(new, allowMissingColumns=True), "merged")  # a table is not read while it is overwritten
            merged.repartition("__part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__part").parquet(f"{self.path}/data")
        self._record(spark, query, epoch)
