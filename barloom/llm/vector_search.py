"""Exact top-k by inner product with vector-approximation files.

1. The approximation file is a table in the shared folder: for blocks of vectors one byte a component (its cell, in
   equal steps between the block's smallest and largest value), the ids, and a hash of each vector.
2. A block of queries, broadcast, scans that file alone.  The cells bound every score from below and above; a vector
   stays if its upper bound reaches the kth largest lower bound that its task has seen, and then that of all tasks.
3. Exact vectors are read in the order of their bounds: the best 2 k of each query, and then those whose upper bound
   reaches the kth exact score found, so the result is certain.

Equal vectors tie and the smaller ids win, so of each only the k + 1 smallest ids of a block go on: a vector that a
third of all rows hold does not multiply candidates.  Query blocks run one after the other; their results are written
and their broadcasts are freed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _session
from . import _text as t

QUERY_ROWS = 16384
QUERY_BYTES = 32 << 20
DATA_BLOCK = 8192
CHUNK = 256  # queries bounded at once
SAFE = 2.0**53
LEAST, MOST = -(2**63), 2**63 - 1
FILE = "dims int, ids binary, tags binary, cells binary, low binary, step binary"
BOUNDS = "query_row long, query_id long, vec_id long, tag long, lower double, upper double"
EXACT = "query_row long, query_id long, vec_id long, score long"


def scaled(column, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rows that take part, their vectors of whole numbers by row): floor(scale * x), x as double.

    Null vectors, and those with a null or non-finite component or one that scaling carries out of a double's range, take no part.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets, inner = np.asarray(column.offsets, np.int64), column.values
    holes = np.asarray(inner.is_null())
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.floor(np.asarray(inner.fill_null(0) if inner.null_count else inner, np.float64) * scale)
    bad = np.r_[0, np.cumsum(holes | ~np.isfinite(flat))]
    good = np.flatnonzero(np.asarray(column.is_valid()) & (bad[offsets[1:]] == bad[offsets[:-1]]))
    return good, [flat[offsets[i] : offsets[i + 1]] for i in good]


class Cells:
    """One block of the approximation file."""

    def __init__(self, low: np.ndarray, step: np.ndarray, cells: np.ndarray):
        self.low, self.step, self.cells = low, step, cells

    @staticmethod
    def of(exact: np.ndarray) -> "Cells":
        low, high = exact.min(0), exact.max(0)
        step = np.maximum(1.0, (high / 255 - low / 255))
        # rounding may put a value just below its cell's corner: bounds allow for a whole step on both sides of it
        return Cells(low, step, np.clip(np.floor((exact - low) / step), 0, 255).astype(np.uint8))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of the score of every query (rows) with every vector, clipped to 64 bits."""
        # a component lies within a step and its rounding of the cell's corner, above or below
        with np.errstate(over="ignore", invalid="ignore"):
            value = (queries * self.step) @ self.cells.T.astype(np.float64) + (queries @ self.low)[:, None]
            largest = np.abs(queries) @ np.maximum(np.abs(self.low), np.abs(self.low + 255 * self.step))
            slack = np.abs(queries) @ self.step
            error = (len(self.low) + 8) * 2.0**-50 * largest + 1
            below, above = value - (np.maximum(-queries, 0) @ self.step + error)[:, None], value + (np.maximum(queries, 0) @ self.step + error)[:, None]
        wild = ~np.isfinite(largest + slack + error)
        below[wild], above[wild] = -np.inf, np.inf
        return np.clip(below, LEAST, MOST), np.clip(above, LEAST, MOST)


def _file(scale: int):
    def blocks(batches):
        held: dict[int, list] = {}
        for batch in batches:
            rows, vectors = scaled(batch.column("embedding"), scale)
            ids, tags = np.asarray(batch.column("vec_id"), np.int64), np.asarray(batch.column("tag"), np.int64)
            for i, v in zip(rows, vectors):
                kept = held.setdefault(len(v), [])
                kept.append((ids[i], tags[i], v))
                if len(kept) == DATA_BLOCK:
                    yield held.pop(len(v))
        yield from held.values()

    def run(batches):
        for block in blocks(batches):
            ids, tags, exact = (np.array(x) for x in zip(*block))
            c = Cells.of(exact) if exact.shape[1] else Cells(np.zeros(0), np.zeros(0), np.zeros(exact.shape, np.uint8))
            made = [x.tobytes() for x in (ids, tags, c.cells, c.low, c.step)]
            yield pa.RecordBatch.from_arrays([pa.array([exact.shape[1]], pa.int32()), *(pa.array([x], pa.binary()) for x in made)], [x.split()[0] for x in FILE.split(", ")])

    return t.trimmed(run)


def first_of_equals(ids: np.ndarray, tags: np.ndarray, k: int) -> np.ndarray:
    """The rows that are among the k + 1 smallest ids of their vector."""
    order = np.lexsort((ids, tags))
    begins = np.flatnonzero(np.r_[True, tags[order][1:] != tags[order][:-1]])
    rank = np.arange(len(order)) - np.repeat(begins, np.diff(np.r_[begins, len(order)]))
    return np.sort(order[rank <= k])


def kth_largest(x: np.ndarray, k: int) -> np.ndarray:
    """By row; the least value where there are fewer than k."""
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k] if x.shape[1] >= k else np.full(len(x), float(LEAST))


def _scan(shared, k: int):
    def run(batches):
        reached = {dims: np.full(len(own), float(LEAST)) for dims, (_, own, _) in shared.value.items()}
        for batch in batches:
            for dims, *raw in zip(*(batch.column(c).to_pylist() for c in range(6))):
                if dims not in shared.value:
                    continue
                rows, own, queries = shared.value[dims]
                ids, tags, low, step = (np.frombuffer(raw[i], kind) for i, kind in ((0, np.int64), (1, np.int64), (3, np.float64), (4, np.float64)))
                some = first_of_equals(ids, tags, k)
                block = Cells(low, step, np.frombuffer(raw[2], np.uint8).reshape(len(ids), dims)[some])
                ids, tags = ids[some], tags[some]
                for lo in range(0, len(own), CHUNK):
                    part = slice(lo, lo + CHUNK)
                    below, above = block.bounds(queries[part])
                    mine = ids[None, :] == own[part, None]
                    below[mine] = LEAST
                    reached[dims][part] = np.maximum(reached[dims][part], kth_largest(below, k))
                    q, v = np.nonzero((above >= reached[dims][part, None]) & ~mine)
                    if len(q):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows[part][q], own[part][q], ids[v], tags[v], below[q, v], above[q, v])], [x.split()[0] for x in BOUNDS.split(", ")])

    return t.trimmed(run)


def dots(vectors: np.ndarray, query: np.ndarray) -> list[int]:
    """Exact inner products of whole numbers, cut to 64 bits."""
    if not len(vectors):
        return []
    if np.abs(vectors).max(initial=0) * np.abs(query).max(initial=0) * max(1, len(query)) < SAFE:
        return (vectors @ query).astype(np.int64).tolist()
    whole = [int(x) for x in query]
    return [max(LEAST, min(MOST, sum(int(a) * b for a, b in zip(v, whole)))) for v in vectors]


def _score(shared, scale: int):
    """Exact scores of (query_row, vec_id, embedding) rows."""

    def run(batches):
        at = {int(r): (int(i), q) for rows, own, queries in shared.value.values() for r, i, q in zip(rows, own, queries)}
        for batch in batches:
            rows, vectors = scaled(batch.column("embedding"), scale)
            asked = np.asarray(batch.column("query_row"), np.int64)[rows]
            ids = np.asarray(batch.column("vec_id"), np.int64)[rows]
            order = np.argsort(asked, kind="stable")
            scores = np.zeros(len(rows), np.int64)
            for part in np.split(order, np.flatnonzero(np.diff(asked[order])) + 1):
                if len(part):
                    scores[part] = dots(np.array([vectors[i] for i in part]), at[int(asked[part[0]])][1])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (asked, [at[int(r)][0] for r in asked], ids, scores)], [x.split()[0] for x in EXACT.split(", ")])

    return t.trimmed(run)


def top_k(data: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Per query (vec_id, embedding) its k highest scores in data: query_id, rank from 1, vec_id, score.

    Candidates are all rows but those with the query's own vec_id; of equal scores the smaller vec_id comes first.  Rows
    with a null vec_id or vector, or with a null or non-finite component (or one beyond a double's range once scaled),
    take no part; vectors of other lengths than the query's are not compared.  Scores beyond 64 bits are cut to them.
    Rows that share a vec_id are queries and candidates each.  Other columns are ignored; empty tables give an empty result.
    """
    spark = data.sparkSession
    wanted = [F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")]
    rows = data.select(*wanted).where("vec_id is not null and embedding is not null").withColumn("tag", F.xxhash64("embedding"))
    asked = queries.select(*wanted).where("vec_id is not null and embedding is not null")
    n, dims = asked.agg(F.count("*"), F.max(F.size("embedding"))).first()
    file = _session.table(rows.mapInArrow(_file(scale), FILE), "cells")
    blocks = max(1, -(-n // min(query_rows, max(1, QUERY_BYTES // (8 * max(1, dims or 1))))))
    path = _session.scratch(spark, "nearest")
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        got = part.toArrow()  # about QUERY_ROWS rows or QUERY_BYTES
        at, vectors = scaled(got["embedding"], scale) if len(got) else (np.zeros(0, np.int64), [])
        ids = np.asarray(got["vec_id"], np.int64)[at] if len(at) else np.zeros(0, np.int64)
        kinds = {d: [i for i, v in enumerate(vectors) if len(v) == d] for d in {len(v) for v in vectors}}
        shared = spark.sparkContext.broadcast({d: (np.array(i, np.int64), ids[i], np.array([vectors[j] for j in i])) for d, i in kinds.items()})
        _block(rows, file, shared, k, scale).write.mode("append").parquet(path)
        shared.unpersist()
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(path)


def _block(rows: DataFrame, file: DataFrame, shared, k: int, scale: int) -> DataFrame:
    """The k best of every query of one block."""
    spark = rows.sparkSession
    by_lower, by_upper = (Window.partitionBy("query_row").orderBy(F.desc(c), "vec_id", "tag") for c in ("lower", "upper"))
    near = _session.table(file.mapInArrow(_scan(shared, k), BOUNDS).distinct(), "bounds")
    edge = near.withColumn("at", F.row_number().over(by_lower)).where(F.col("at") == k).select("query_row", F.col("lower").alias("edge"))
    near = near.join(edge, "query_row", "left").where("edge is null or upper >= edge").withColumn("at", F.row_number().over(by_upper))
    near = _session.table(near.select("query_row", "vec_id", "tag", "upper", "at"), "candidates")

    def read(pairs: DataFrame) -> DataFrame:
        """Exact scores of pairs; rows of no pair are left out before anything is shuffled."""
        allowed = spark.sparkContext.broadcast(_session.id_filter(pairs.select("vec_id"), "vec_id"))
        slot = F.pmod(F.xxhash64("vec_id"), F.lit(len(allowed.value) * 64)).alias("slot")
        some = rows.select("vec_id", "tag", "embedding", slot).mapInArrow(_known(allowed), "vec_id long, tag long, embedding array<double>")
        return some.join(pairs.select("query_row", "vec_id", "tag"), ["vec_id", "tag"]).select("query_row", "vec_id", "embedding").mapInArrow(_score(shared, scale), EXACT)

    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    first = _session.table(read(near.where(F.col("at") <= 2 * k)), "first")
    sure = first.withColumn("at", F.row_number().over(best)).where(F.col("at") == k).select("query_row", F.col("score").cast("double").alias("sure"))
    # a double's rounding of the kth score must not cut off its equals
    rest = near.where(F.col("at") > 2 * k).join(sure, "query_row", "left").where("sure is null or upper >= sure - abs(sure) * 1e-15")
    found = first.union(read(rest)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _known(allowed):
    def run(batches):
        seen = allowed.value
        for batch in batches:
            slot = np.asarray(batch.column("slot"), np.int64)
            some = np.flatnonzero((seen[slot >> 6] >> (slot & 63)) & 1)
            if len(some):
                yield batch.take(pa.array(some)).select(["vec_id", "tag", "embedding"])

    return t.trimmed(run)
