"""Centroid clustering by Lloyd rounds with Elkan's bounds.

Every vector carries its centroid, an upper bound of the distance to it and a lower bound of the distance to each of the k
centroids, kept in a table that each round reads and writes anew.  After a move of the centroids the bounds are loosened by
the moves; a distance is computed only where neither bound nor half the distance between two centroids rules it out.
Distances that are computed are exact integers.  Bounds are rounded away from them and prune by strict comparisons, so a
pruned centroid is strictly farther and ties still go to the smaller number: the result equals plain rounds.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _session
from . import _text as t
from ._vectors import first, matrix, usable, whole

ROOM = 1e-12  # relative room of a bound: above any rounding of a root, a sum or a difference of doubles
STATE = "cluster int, tried int, v array<int>, upper double, lower array<float>"


def above(x):
    return x * (1 + ROOM)


def below(x):
    return x * (1 - ROOM)


def squared(v: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows from one centre, or from a centre each."""
    off = v.astype(np.int64) - centre
    return np.einsum("ij,ij->i", off, off)


@dataclass
class Clusters:
    """centroids (k by dims), and how many distances each pass computed."""

    centroids: np.ndarray
    tried: list[int] = field(default_factory=list)

    def digests(self) -> list[str]:
        """sha256 of each centroid's components as decimal integers."""
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids.tolist()]


def reassigned(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, moved: np.ndarray):
    """(cluster, upper, lower, distances computed by row) of a batch after its centroids have moved; arrays are changed."""
    k = len(centroids)
    upper = above(upper + moved[cluster])
    lower = np.maximum(lower - moved - ROOM * (lower + moved), 0)
    apart = np.array([squared(centroids, c) for c in centroids])
    half = below(np.sqrt(apart.astype(float))) / 2
    np.fill_diagonal(half, np.inf)
    tried = np.zeros(len(v), np.int32)
    best = np.zeros(len(v), np.int64)
    open_ = np.flatnonzero(~(upper < half.min(1)[cluster]))
    best[open_] = squared(v[open_], centroids[cluster[open_]])
    tried[open_] = 1
    upper[open_] = above(np.sqrt(best[open_].astype(float)))
    for j in range(k):
        own = cluster[open_]
        some = open_[(own != j) & ~(upper[open_] < lower[open_, j]) & ~(upper[open_] < half[own, j])]
        if not len(some):
            continue
        d = squared(v[some], centroids[j])
        tried[some] += 1
        root = np.sqrt(d.astype(float))
        lower[some, j] = below(root)
        nearer = (d < best[some]) | ((d == best[some]) & (j < cluster[some]))
        won = some[nearer]
        lower[won, cluster[won]] = below(np.sqrt(best[won].astype(float)))
        cluster[won], best[won], upper[won] = j, d[nearer], above(root[nearer])
    return cluster, upper, lower, tried


def _floats(lower: np.ndarray) -> np.ndarray:
    """Single precision, rounded down."""
    out = lower.astype(np.float32)
    return np.where(out > lower, np.nextafter(out, np.float32(-np.inf)), out)


def _pass(centroids: np.ndarray, moved: np.ndarray, names: list[str], last: bool):
    """One assignment of all rows; the last one gives exact distances in place of the bounds."""
    k, dims = centroids.shape

    def run(batches):
        for batch in batches:
            v = matrix(batch.column("v"), dims)[1]
            cluster, upper = (np.array(batch.column(c)) for c in ("cluster", "upper"))
            lower = np.array(batch.column("lower").flatten(), float).reshape(len(v), k)
            cluster, upper, lower, tried = reassigned(v, cluster, upper, lower, centroids, moved)
            kept, made = [batch.column(c) for c in names], [pa.array(cluster, pa.int32()), pa.array(tried, pa.int32())]
            if last:
                yield pa.RecordBatch.from_arrays([*kept, *made, pa.array(squared(v, centroids[cluster]))], [*names, "cluster", "tried", "distance"])
                continue
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * k), pa.array(_floats(lower).ravel()))
            yield pa.RecordBatch.from_arrays([*kept, *made, batch.column("v"), pa.array(upper), lists], [*names, "cluster", "tried", "v", "upper", "lower"])

    return t.trimmed(run)


def _sums(k: int, dims: int):
    """Of all rows of a task: n, distances computed and summed components by cluster, as one row a cluster."""

    def run(batches):
        total, n, tried = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        for batch in batches:
            _, v = matrix(batch.column("v"), dims)
            cluster = np.asarray(batch.column("cluster"))
            np.add.at(tried, cluster, np.asarray(batch.column("tried")))
            for j in np.unique(cluster):
                some = v[cluster == j]
                total[j] += some.sum(0, dtype=np.int64)
                n[j] += len(some)
        used = np.flatnonzero(n)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array(tried[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], ["cluster", "n", "tried", "total"])

    return t.trimmed(run)


def _moved(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """(floor of the mean of every cluster's vectors, empty ones as before; distances computed); k * dims sums reach the driver."""
    k, dims = centroids.shape
    parts = state.select("v", "cluster", "tried").mapInArrow(_sums(k, dims), "cluster int, n long, tried long, total array<long>")
    cells = parts.select("cluster", "n", "tried", F.posexplode("total").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum("tried").alias("tried"))
    out, tried = centroids.copy(), 0
    for r in cells.collect():
        out[r.cluster, r.at] = r.x // r.n
        tried += r.tried if r.at == 0 else 0
    return out, tried


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3") -> tuple[DataFrame, Clusters]:
    """(vec_id, cluster, distance of every usable vector with ``dims`` components as a written table, the clusters).

    Components become floor(scale * x).  Centroids start as the k vectors with the smallest sha256 of ``seed:vec_id`` (null
    ids last; repeated ids by their components), fewer if there are fewer.  Each round assigns every vector to the nearest
    centroid (squared distance, ties to the smaller number) and moves each non-empty centroid to the componentwise floor of
    its mean; then all are assigned once more.  Rounds end early where no centroid moves, as no later one changes anything.

    Null vectors, those with null or non-finite components and those of another length have no row; one with components
    beyond _vectors.limit has a null cluster and distance and moves no centroid.  Repeated rows count each; other columns are
    ignored; an empty table gives an empty result.  A round's table replaces the one before.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable() & (F.size("embedding") == dims)).select("vec_id", whole(dims, scale).alias("v"))
    start = first(rows, k, F.asc_nulls_last(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)))
    found = Clusters(np.array(start, np.int64).reshape(len(start), dims))
    if not start:
        return rows.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), found
    kind = rows.schema["vec_id"].dataType.simpleString()
    none = F.array_repeat(F.lit(0.0).cast("float"), len(start))
    state = rows.withColumns({"cluster": F.lit(0), "upper": F.lit(float("inf")), "lower": none})
    moved, path = np.zeros(len(start)), None
    for _ in range(rounds):
        was, path = path, _session.scratch(spark, "round")
        state.where("v is not null").mapInArrow(_pass(found.centroids, moved, ["vec_id"], False), f"vec_id {kind}, {STATE}").write.parquet(path)
        state = spark.read.schema(f"vec_id {kind}, {STATE}").parquet(path)
        if was:
            _session.delete(spark, was)
        new, tried = _moved(state, found.centroids)
        found.tried.append(tried)
        moved = above(np.sqrt(squared(new, found.centroids).astype(float)))
        found.centroids = new
        if not moved.any():
            break
    done = state.mapInArrow(_pass(found.centroids, moved, ["vec_id"], True), f"vec_id {kind}, cluster int, tried int, distance long")
    out = _session.table(done, "clusters")
    if path:
        _session.delete(spark, path)
    beyond = rows.where("v is null").select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
    found.tried.append(out.agg(F.sum("tried")).first()[0] or 0)
    return out.select("vec_id", "cluster", "distance").union(beyond), found


def with_inertia(assigned: DataFrame, found: Clusters) -> DataFrame:
    """assigned with cluster_inertia, inertia (null beyond 64 bits) and centroid_sha256; one row a cluster is broadcast."""
    spark = assigned.sparkSession
    sums = {r.cluster: int(r.s) for r in assigned.where("cluster is not null").groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38, 0)")).alias("s")).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    facts = [(j, fits(sums.get(j, 0)), digest) for j, digest in enumerate(found.digests())]
    small = F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, centroid_sha256 string"))
    return assigned.join(small, "cluster", "left").select(*assigned.columns, "cluster_inertia", F.lit(fits(sum(sums.values()))).cast("long").alias("inertia"), "centroid_sha256")
