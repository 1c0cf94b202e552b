"""Vector code compression: product quantisation trained by an RDD treeAggregate over columnar NumPy part blocks.

Arrow batches of vectors become blocks with one contiguous column a dimension.  Each round broadcasts the codebooks, and
every partition folds its blocks into int64 tensors: the distances of a part to all entries accumulate dimension by
dimension, and np.add.at adds the part to the sums and counts of its nearest entry.  The tensors, whose size does not depend
on the data, merge through a reduction tree.  All numbers are whole, so results do not depend on the order of merging.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _session
from . import _text as t
from ._vectors import first, matrix, usable, whole

STEP = 4096  # vectors whose distances to all entries are held at once
HOT = 4096  # groups with more than one row in so many are summed up apart


def nearest(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry for each vector of a part (dimensions by vectors); ties to the lower index."""
    reach = int(np.abs(part).max(initial=0)) + int(np.abs(entries).max(initial=0))
    kind = np.int32 if len(part) * reach * reach < 2**31 else np.int64
    index, distance = np.zeros(part.shape[1], np.int64), np.zeros(part.shape[1], np.int64)
    for lo in range(0, part.shape[1], STEP):
        some = part[:, lo : lo + STEP].astype(kind)
        total = np.zeros((len(entries), some.shape[1]), kind)
        for j in range(len(part)):
            off = some[j] - entries[:, j, None].astype(kind)
            off *= off
            total += off
        at = total.argmin(0)
        index[lo : lo + STEP], distance[lo : lo + STEP] = at, total[at, np.arange(len(at))]
    return index, distance


def _columns(dims: int):
    def run(batches):
        for batch in batches:
            rows, v = matrix(batch.column("v"), dims)
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int32()), pa.array([np.ascontiguousarray(v.T).tobytes()], pa.binary())], ["n", "columns"])

    return t.trimmed(run)


def _folded(shared):
    """Adds one block to (sums by part, entry and position; counts by part and entry)."""

    def fold(found, block):
        books = shared.value
        width = books.shape[2]
        for p, entries in enumerate(books):
            part = block[p * width : (p + 1) * width]
            index, _ = nearest(part, entries)
            np.add.at(found[0][p], index, part.T)
            np.add.at(found[1][p], index, 1)
        return found

    return fold


def _merged(a, b):
    return a[0] + b[0], a[1] + b[1]


def train(rows: DataFrame, start: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks (part, entry, position) after the rounds; rows: v.  Unused entries stay."""
    spark, (parts, entries, width) = rows.sparkSession, start.shape
    dims, books = parts * width, start
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        blocks = rows.select("v").mapInArrow(_columns(dims), "n int, columns binary").rdd.map(lambda r: np.frombuffer(r.columns, np.int32).reshape(dims, r.n))
        depth = max(2, math.ceil(math.log(max(2, blocks.getNumPartitions()), 128)))
        zero = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        sums, counts = blocks.treeAggregate(zero, _folded(shared), _merged, depth)
        books = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], books)
        shared.unpersist()
    return books


def _coded(books: np.ndarray, names: list[str]):
    parts, _, width = books.shape

    def run(batches):
        for batch in batches:
            rows, v = matrix(batch.column("v"), parts * width)
            code, error = np.zeros((len(rows), parts), np.uint8), np.zeros(len(rows), np.int64)
            for p, entries in enumerate(books):
                code[:, p], off = nearest(np.ascontiguousarray(v[:, p * width : (p + 1) * width].T), entries)
                error += off
            text = code.tobytes().hex()
            at = np.full(batch.num_rows, -1, np.int64)
            at[rows] = np.arange(len(rows))
            take = pa.array(at, mask=at < 0)
            text = pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), text.take(take), pa.array(error, pa.int64()).take(take)], [*names, "code", "error"])

    return t.trimmed(run)


class Codebooks:
    """Entries (part, entry, position) over vectors of ``dims`` components scaled by ``scale``."""

    def __init__(self, books: np.ndarray, dims: int, scale: int):
        self.books, self.dims, self.scale = books, dims, scale

    def sha256(self) -> str:
        """Digest of all components as decimal integers, by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def encode(self, vectors: DataFrame, keep: list[str]) -> DataFrame:
        """The columns to keep, code (two hex digits a part) and error (squared distance summed over parts).

        Vectors that are null or hold null or non-finite components have no row; those of another length, or with
        components beyond _vectors.limit, have a null code and error.
        """
        rows = vectors.where(usable()).select(*keep, whole(self.dims, self.scale).alias("v"))
        kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
        if not self.books.size:
            return rows.select(*keep, F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        return rows.mapInArrow(_coded(self.books, keep), f"{kinds}, code string, error long")


def fit(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Codebooks:
    """Codebooks trained on every usable vector (vec_id, embedding) as long as the one with the smallest vec_id.

    Components become floor(scale * x).  Each part's entries start as that part of the ``entries`` smallest vec_ids (nulls
    last; equal ids by their components), fewer if there are fewer vectors.  Lengths that are no multiple of ``parts`` have
    no equal parts and take no part; an empty table gives empty codebooks.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index has two hex digits: 1 to 256 entries")
    cut = vectors.where(usable()).where((F.size("embedding") > 0) & (F.size("embedding") % parts == 0))
    dims = cut.agg(F.min(F.struct(F.col("vec_id").isNull(), "vec_id", F.size("embedding").alias("n"))).alias("m")).first().m
    if dims is None:
        return Codebooks(np.zeros((parts, 0, 0), np.int64), 0, scale)
    rows = cut.select("vec_id", whole(dims.n, scale).alias("v"))
    start = np.array(first(rows, entries, F.asc_nulls_last("vec_id")), np.int64).reshape(-1, parts, dims.n // parts).transpose(1, 0, 2)
    return Codebooks(train(rows, start, rounds) if start.size else start, dims.n, scale)


def with_sum(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """rows with the sum of value over equal keys, nulls together, as a long (null beyond 64 bits); rows is read twice.

    Sums come from partial aggregates.  Keys with at least one row in HOT, of which there are at most HOT, meet their rows by
    broadcast, so a key with a third of all rows is never shuffled; all others meet in a shuffled join.
    """
    sums = rows.groupBy(key).agg(F.expr(f"try_sum(`{value}`)").alias(name), F.count("*").alias("__n"))
    least = rows.count() / HOT
    hot = F.broadcast(sums.where(F.col("__n") >= least).select(F.col(key).alias("__key"), name))
    same = F.col(key).eqNullSafe(F.col("__key"))
    if sums.limit(HOT + 1).count() <= HOT:
        small = F.broadcast(sums.select(F.col(key).alias("__key"), name))
        return rows.join(small, same).select(*rows.columns, name)
    rest = sums.where(F.col("__n") < least).select(F.col(key).alias("__key"), name)
    return rows.join(hot, same).select(*rows.columns, name).union(rows.join(hot, same, "left_anti").join(rest, same).select(*rows.columns, name))


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error of every usable vector as a written table, the codebooks); see fit and Codebooks.encode.

    Null labels and ids stay; repeated rows are coded each; other columns are ignored.
    """
    books = fit(vectors, parts, entries, rounds, scale)
    return _session.table(books.encode(vectors, ["vec_id", "label"]), "codes"), books
