"""Sinks: versioned Parquet tables with append, reload, upsert and replacement, and CSV reports.

A table is a folder; every change writes new files beside the old ones and then a log entry that names the folders of
the new version, so a reader sees a whole version and a lost task leaves nothing but files that no entry names.  One
writer at a time; an entry that exists is never overwritten, so that of two writers one fails.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.bars import upsert


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, else in the warehouse (locally a temporary folder); gone when the driver ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        shared = "file://" + tempfile.gettempdir() if master.startswith("local[") or master == "local" else spark.conf.get("spark.sql.warehouse.dir")
    path = f"{shared.rstrip('/')}/barloom-{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def laid_out(rows: DataFrame, *order: str) -> DataFrame:
    """rows dealt by the first column, sorted by all, and checkpointed in the shared folder: windows and groups by that column need no exchange."""
    spark = rows.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch(spark, "checkpoints"))
    parts, adaptive = int(spark.conf.get("spark.sql.shuffle.partitions")), spark.conf.get("spark.sql.adaptive.enabled")
    try:  # a checkpoint of an adaptive plan does not know how it is dealt and sorted
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        return rows.repartition(parts, order[0]).sortWithinPartitions(*order).checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows as a table in the shared folder, for what is read more than once."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


class Table:
    """A table of Parquet folders at a path; rows of all its folders are the current version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._at = lambda below: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}")
        self._fs = self._at("log").getFileSystem(spark._jsc.hadoopConfiguration())

    def _version(self) -> int:
        if not self._fs.exists(self._at("log")):
            return 0
        names = [x.getPath().getName() for x in self._fs.listStatus(self._at("log"))]
        done = [int(x) for x in names if x.isdigit() and self._fs.exists(self._at(f"log/{x}/_SUCCESS"))]
        return max(done, default=0)

    def folders(self) -> list[str]:
        version = self._version()
        return json.loads(self.spark.read.text(f"{self.path}/log/{version}").first()[0]) if version else []

    def _commit(self, rows: DataFrame, kept: list[str]) -> None:
        version = self._version() + 1
        folder = f"data/{version}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.path}/{folder}")
        entry = self.spark.createDataFrame([(json.dumps([*kept, folder]),)], "value string")
        entry.coalesce(1).write.text(f"{self.path}/log/{version}")  # fails where another writer has made it

    def read(self) -> DataFrame:
        """The rows of the current version; columns that only some folders have are null elsewhere."""
        held = self.folders()
        if not held:
            raise ValueError(f"the table at {self.path} is empty")
        return self.spark.read.option("mergeSchema", True).parquet(*[f"{self.path}/{x}" for x in held])

    def append(self, rows: DataFrame) -> None:
        self._commit(rows, self.folders())

    def reload(self, rows: DataFrame) -> None:
        """Truncate and load: nothing of the version before stays."""
        self._commit(rows, [])

    def upsert(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """rows replace the rows of equal keys; returns them as the table now has them."""
        self._commit(upsert(self.read(), rows, keys) if self.folders() else rows, [])
        return self.read().join(rows.select(keys).distinct(), keys, "left_semi")

    def replace(self, rows: DataFrame, keys: list[str]) -> None:
        """Delete all rows whose keys occur in rows, then insert rows: a document's chunks, a symbol's history."""
        old = self.read().join(rows.select(keys).distinct(), keys, "left_anti") if self.folders() else None
        self._commit(rows if old is None else old.unionByName(rows, allowMissingColumns=True), [])


def write_report(rows: DataFrame, path: str, columns: list[str]) -> None:
    """One CSV file with a byte order mark, the columns in the given order, and columns that rows lack left empty."""
    have = set(rows.columns)
    out = rows.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns])
    out.withColumnRenamed(columns[0], "﻿" + columns[0]).coalesce(1).write.csv(path, header=True, encoding="UTF-8", emptyValue="")
