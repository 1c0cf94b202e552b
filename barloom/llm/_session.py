"""Shared folder, partition counts and small distributed helpers."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset the one set before, else one in the warehouse, or a temporary one of a local session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.getCheckpointDir() is None:
        local = spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")
        at = "file://" + tempfile.mkdtemp(prefix="barloom-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/barloom-scratch"
        spark.sparkContext.setCheckpointDir(at)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder: later reads survive lost executors and do not recompute."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_MADE: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that Hadoop deletes when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    _MADE.append(path)
    return path


def release(spark: SparkSession, first: int = 0) -> int:
    """Delete the scratch folders made since there were ``first``, but for the latest one; returns how many are left.

    For a driver that runs one thing after another and reads nothing but the latest table from then on.
    """
    for path in _MADE[first:-1]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _MADE[first:] = _MADE[first:][-1:]
    return len(_MADE)


def delete(spark: SparkSession, path: str) -> None:
    """Delete one scratch folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _MADE.remove(path)


def table(df: DataFrame, name: str) -> DataFrame:
    """df as a compressed table in the shared folder, for what is read more than once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(F.col(column).cast("string")))).first()[0] or 0


def fan(spark: SparkSession, size: int = 0, limit: int = 64 << 20) -> int:
    """Groups of packed exchanges over ``size`` bytes of text.

    Two to a shuffle partition even hashing out and keep the number of packed rows, groups times ranges, low; where
    a group, which one task holds, would be larger than ``limit``, there are more.
    """
    return max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // limit))


def id_filter(ids: DataFrame, column: str, log2_bits: int = 25) -> np.ndarray:
    """A bitmap of hashed ids, at most 2**log2_bits bits (4 MB) whatever the number of ids.

    It only ever lets too much through, so it may stand before an exact semi join.
    """
    at = F.pmod(F.xxhash64(column), F.lit(1 << log2_bits))
    rows = (
        ids.select(F.shiftright(at, 6).cast("int").alias("i"), F.expr(f"shiftleft(1L, cast({_pmod(column, log2_bits)} % 64 as int))").alias("m"))
        .groupBy("i").agg(F.bit_or("m").alias("m"))
    )
    words, got = np.zeros(1 << (log2_bits - 6), np.int64), rows.toArrow()
    words[np.asarray(got["i"], np.int64)] = np.asarray(got["m"], np.int64)
    return words


def _pmod(column: str, log2_bits: int) -> str:
    return f"pmod(xxhash64({column}), {1 << log2_bits})"


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every a has one b and no b is an a: then each b is its component's smallest id."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("root")).union(edges.select(F.col("b").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("root")))
    return not ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("root").alias("root")).where("out + root > 1").limit(1).count()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root) for every id of the undirected edges (a, b); root is the smallest id reachable.

    Alternates large-star and small-star steps until the edges are a forest of stars.  A hub's neighbours meet only in
    partial aggregates and in joins that adaptive execution splits, never in one collected list.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        if _is_forest_of_stars(now):
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        now = cut(small.where("a <> b").distinct())
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).union(now.select(F.col("b").alias("id"), F.col("b").alias("root"))).distinct()
