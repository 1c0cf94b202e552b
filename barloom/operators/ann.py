"""Approximate nearest neighbours by cosine: inverted lists around centroids, with product-quantised codes.

The centroids and the codebooks are fitted on a bounded sample; every vector is indexed.  A vector goes to the list of its
nearest centroid, as a code of ``parts`` bytes that quantises what is left after the centroid is taken away.  Lists are
written as blocks of up to BLOCK vectors, a folder for each list, dealt by ranges of (list, hash of the id), so a list with a
third of all vectors spreads over tasks and files like any other; lists have no cap.

A search reads the folders of the probed lists alone.  The queries that probe a list meet its blocks in packs, so the join
has one row for a block and PACK queries, not for each pair; what a code says about the distance picks the candidates, and
exact distances of those decide.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators.retrieval import cosine_distance

SAMPLE_BYTES = 32 << 20
SAMPLE_ROWS = 1 << 17
LISTS = 1 << 14
POINTS = 16  # of the sample for each list, at least
BLOCK = 256
PACK = 32
QUERIES = 4096  # whose exact neighbours are found in one pass
ROWS = 1 << 14  # rows that a task of a search makes at once
CELLS = 1 << 22  # distances that a task computes at once


def usable(column: str):
    """Whether a vector has a direction: no null or non-finite component, and a length."""
    x = F.col(column).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 1e150))
    return F.coalesce(fine & F.exists(x, lambda v: F.abs(v) > 1e-150), F.lit(False))


def _unit(column, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of that many components, their unit vectors) of an Arrow list column without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = np.flatnonzero(np.asarray(pa.compute.list_value_length(column)) == dims)
    x = np.asarray(column.take(pa.array(rows)).flatten(), float).reshape(len(rows), dims)
    x = x / np.abs(x).max(axis=1, initial=1e-300)[:, None]
    return rows, (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32)


def _means(x: np.ndarray, k: int, rounds: int, rng, spherical: bool) -> np.ndarray:
    """k means of the rows; an empty one moves to a row far from its mean."""
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near, far = _nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        count = np.bincount(near, minlength=k)
        used = count > 0
        c[used] = total[used] / count[used, None]
        if not used.all():
            c[~used] = x[np.argsort(-far)[: int((~used).sum())]]
        if spherical:
            c /= np.maximum(np.sqrt((c * c).sum(1)), 1e-12)[:, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance less the row's own length) of the nearest of c for every row."""
    near, far, size = np.zeros(len(x), np.int64), np.zeros(len(x), np.float32), (c * c).sum(1)
    step = max(1, min(4096, CELLS // len(c)))
    for lo in range(0, len(x), step):
        d = size - 2 * (x[lo : lo + step] @ c.T)
        near[lo : lo + step] = d.argmin(1)
        far[lo : lo + step] = d.min(1)
    return near, far


def _needed(x: np.ndarray, centroids: np.ndarray, rng, queries: int = 512, k: int = 10) -> np.ndarray:
    """Of the k nearest of some of the sample's rows in the sample, the share that the 1, 2, ... lists nearest to the row hold."""
    some = rng.choice(len(x), min(queries, len(x)), replace=False)
    likeness = x[some] @ x.T
    likeness[np.arange(len(some)), some] = -np.inf
    k = min(k, len(x) - 1)
    if not k:
        return np.ones(len(centroids), np.float32)
    near = np.argpartition(-likeness, k - 1, axis=1)[:, :k]
    order = np.argsort(-(x[some] @ centroids.T), axis=1, kind="stable")
    turn = np.empty_like(order)
    np.put_along_axis(turn, order, np.arange(len(centroids))[None, :], axis=1)
    at = np.take_along_axis(turn, _nearest(x, centroids)[0][near], axis=1)
    return (np.cumsum(np.bincount(at.ravel(), minlength=len(centroids))) / at.size).astype(np.float32)


class Index:
    """Centroids (list, component), codebooks (part, entry, position) and the blocks at a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        model = {r.name: np.frombuffer(r.data, np.float32).reshape(r.shape) for r in spark.read.parquet(f"{self.path}/model").collect()}
        self.centroids, self.books, self.covered = model["centroids"], model["books"], model["probes"]

    @property
    def dims(self) -> int:
        return self.centroids.shape[1]

    def probes(self, share: float) -> int:
        """The fewest lists that held this share of the neighbours in the sample, all where none do."""
        return int(np.searchsorted(self.covered, min(share, 1.0))) + 1 if share <= self.covered[-1] else len(self.covered)

    @staticmethod
    def build(vectors: DataFrame, path: str, id_: str = "vec_id", column: str = "embedding", lists: int | None = None, parts: int = 16, seed: int = 7) -> "Index":
        """Fit on the rows with the smallest hashes of their ids (SAMPLE_ROWS or SAMPLE_BYTES), and index every row.

        The length is the one that most of the sample has; vectors of another length, null ones, and those with null or
        non-finite components or of length 0 have no cosine distance and are not indexed.  Rows that share an id are indexed each.
        ``lists``: about the square root of the number of rows where it is not given, at most one for POINTS rows of the sample.
        """
        spark = vectors.sparkSession
        rows = vectors.where(usable(column) & F.col(id_).isNotNull()).select(F.col(id_).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
        n, widest = rows.agg(F.count("*"), F.max(F.size("v"))).first()
        if not n:
            raise ValueError("no vector to index")
        bound = max(256, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * widest)))
        got = rows.orderBy(F.xxhash64("id"), "id").limit(bound).select("v").toArrow()["v"].combine_chunks()
        sizes = np.asarray(pa.compute.list_value_length(got))
        dims = int(np.bincount(sizes).argmax())
        if dims % parts:
            raise ValueError(f"{dims} components do not make {parts} equal parts")
        x, rng = _unit(got, dims)[1], np.random.default_rng(seed)
        k = lists or 1 << max(0, round(np.log2(max(1, n)) / 2))
        k = max(1, min(k, LISTS, len(x) // POINTS))
        centroids = _means(x, k, 12, rng, True)
        left = (x - centroids[_nearest(x, centroids)[0]]).reshape(len(x), parts, -1)
        books = np.stack([_means(np.ascontiguousarray(left[:, p]), min(256, len(x)), 10, rng, False) for p in range(parts)])
        probes = _needed(x, centroids, rng)
        model = [("probes", [len(probes)], bytearray(probes.tobytes())), ("centroids", list(centroids.shape), bytearray(centroids.astype(np.float32).tobytes())), ("books", list(books.shape), bytearray(books.astype(np.float32).tobytes()))]
        spark.createDataFrame(model, "name string, shape array<int>, data binary").coalesce(1).write.parquet(f"{path}/model")
        index = Index(spark, path)
        index.add(rows)
        return index

    def add(self, rows: DataFrame) -> None:
        """Append the blocks of usable (id, v) rows."""
        coded = rows.mapInArrow(self._coded(), "list int, id long, code binary")
        dealt = coded.repartitionByRange("list", F.xxhash64("id")).sortWithinPartitions("list", "id")
        dealt.mapInArrow(_blocks, "list int, n int, ids binary, codes binary").write.partitionBy("list").mode("append").parquet(f"{self.path}/lists")

    def _coded(self):
        shared, dims = self.spark.sparkContext.broadcast((self.centroids, self.books)), self.dims

        def run(batches):
            centroids, books = shared.value
            for batch in batches:
                at, x = _unit(batch.column("v"), dims)
                if not len(at):
                    continue
                near = _nearest(x, centroids)[0]
                left = (x - centroids[near]).reshape(len(x), len(books), -1)
                codes = np.stack([_nearest(np.ascontiguousarray(left[:, p]), b)[0] for p, b in enumerate(books)], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), batch.column("id").take(pa.array(at)), pa.array([c.tobytes() for c in codes], pa.binary())], ["list", "id", "code"])

        return run

    def probed(self, queries: DataFrame, probes: int) -> DataFrame:
        """(list, query_id, q) of the lists with the nearest centroids; queries: (query_id, q)."""
        shared, dims = self.spark.sparkContext.broadcast(self.centroids), self.dims

        def run(batches):
            for batch in batches:
                at, x = _unit(batch.column("q"), dims)
                if not len(at):
                    continue
                step = max(1, ROWS // probes)  # queries at once: each is repeated for its lists
                for lo in range(0, len(at), step):
                    own = x[lo : lo + step]
                    some = np.argsort(-(own @ shared.value.T), axis=1, kind="stable")[:, :probes]
                    again = np.repeat(np.arange(len(own)), some.shape[1])
                    unit = pa.array(list(own), pa.list_(pa.float32())).take(pa.array(again))
                    yield pa.RecordBatch.from_arrays([pa.array(some.ravel(), pa.int32()), batch.column("query_id").take(pa.array(at[lo + again])), unit], ["list", "query_id", "q"])

        return queries.mapInArrow(run, "list int, query_id long, q array<float>")

    def candidates(self, queries: DataFrame, probes: int, most: int) -> DataFrame:
        """(query_id, id): the ``most`` best of each query's probed lists by their codes; not the query's own id."""
        probed = self.probed(queries, probes)
        counts = probed.groupBy("list").agg(F.count("*").alias("n")).collect()  # a row for a list, at most LISTS
        wanted = [r.list for r in counts]
        packs = F.broadcast(self.spark.createDataFrame([(r.list, -(-r.n // PACK)) for r in counts], "list int, packs int"))
        packed = (
            probed.join(packs, "list").groupBy("list", F.pmod(F.xxhash64("query_id"), F.col("packs")).alias("pack"))
            .agg(F.collect_list("query_id").alias("asked"), F.flatten(F.collect_list("q")).alias("q"))
        )
        blocks = self.spark.read.parquet(f"{self.path}/lists").where(F.col("list").isin(wanted))
        scored = blocks.join(packed, "list").mapInArrow(self._scored(most), "query_id long, id long, score float")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return scored.withColumn("at", F.row_number().over(best)).where(F.col("at") <= most).select("query_id", "id")

    def _scored(self, most: int):
        shared = self.spark.sparkContext.broadcast((self.centroids, self.books))

        def run(batches):
            centroids, books = shared.value
            dims = centroids.shape[1]

            @lru_cache(64)
            def tables(raw: bytes) -> np.ndarray:
                q = np.frombuffer(raw, np.float32).reshape(-1, len(books), dims // len(books))
                return np.einsum("qpw,pew->qpe", q, books)

            def made(found):
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["query_id", "id", "score"])

            for batch in batches:
                found, n = [], 0
                for i in range(batch.num_rows):
                    ids, codes = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in (("ids", np.int64), ("codes", np.uint8)))
                    codes = codes.reshape(len(ids), -1)
                    asked, q = np.asarray(batch.column("asked")[i].values), np.asarray(batch.column("q")[i].values)
                    table = tables(q.tobytes())
                    score = np.repeat((q.reshape(len(asked), dims) @ centroids[batch.column("list")[i].as_py()])[:, None], len(ids), 1)
                    for p in range(codes.shape[1]):
                        score += table[:, p].take(codes[:, p], axis=1)
                    score[asked[:, None] == ids[None, :]] = -np.inf
                    top = np.argsort(-score, axis=1, kind="stable")[:, :most]
                    row = np.repeat(np.arange(len(asked)), top.shape[1])
                    value = score[row, top.ravel()]
                    kept = value > -np.inf
                    found.append((asked[row[kept]], ids[top.ravel()[kept]], value[kept]))
                    n += len(found[-1][0])
                    if n >= ROWS:
                        yield made(found)
                        found, n = [], 0
                if found:
                    yield made(found)

        return run

    def search(self, queries: DataFrame, vectors: DataFrame, k: int = 10, probes: int | None = None, refine: int = 20, id_: str = "vec_id", column: str = "embedding") -> DataFrame:
        """(query_id, rank, id, distance) of about the k nearest of every query by exact cosine distance, ties to the smaller id.

        queries: (query_id, q) with whole ids; a query's own id is no neighbour.  ``probes``: as many lists as held 0.98 of the
        neighbours in the sample where it is not given.  Candidates are the ``refine`` * k best by code.
        vectors: what was indexed, for exact distances; equal rows count once.
        """
        asked = queries.where(usable("q") & F.col("query_id").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), F.col("q").cast("array<double>").alias("q"))
        found = self.candidates(asked, probes or self.probes(0.98), refine * k).distinct()
        exact = vectors.where(usable(column)).select(F.col(id_).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
        rows = found.join(exact, "id").join(asked, "query_id").select("query_id", "id", F.round(cosine_distance("v", "q"), 6).alias("distance"))
        return ranked(rows, k)


def ranked(rows: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def _blocks(batches):
    """Sorted (list, id, code) rows as blocks; a block never spans two lists."""
    for batch in batches:
        lists = np.asarray(batch.column("list"))
        ids = np.asarray(batch.column("id"))
        codes = batch.column("code").to_pylist()
        edges = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])
        cuts = [i for a, b in zip(edges, np.r_[edges[1:], len(lists)]) for i in range(a, b, BLOCK)] + [len(lists)]
        rows = [(int(lists[i]), j - i, ids[i:j].tobytes(), b"".join(codes[i:j])) for i, j in zip(cuts, cuts[1:]) if i < j]
        if rows:
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], ["list", "n", "ids", "codes"])


def exact(vectors: DataFrame, queries: DataFrame, k: int = 10, id_: str = "vec_id", column: str = "embedding") -> DataFrame:
    """What search() approximates, by brute force: every query against all rows; QUERIES queries (broadcast) in each pass."""
    spark = vectors.sparkSession
    asked = queries.where(usable("q") & F.col("query_id").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), F.col("q").cast("array<double>").alias("q"))
    rows = vectors.where(usable(column) & F.col(id_).isNotNull()).select(F.col(id_).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    parts = max(1, -(-asked.count() // QUERIES))
    out = None
    for part in range(parts):
        got = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).toArrow()  # about QUERIES rows
        found = rows.mapInArrow(_brute(spark.sparkContext.broadcast(got), k), "query_id long, id long, distance double")
        out = found if out is None else out.union(found)
    return ranked(out, k)


def _brute(shared, k: int):
    """The k best of a task's rows for every query; CELLS distances at a time, and what is best so far."""

    def run(batches):
        got = shared.value
        if not len(got):
            return
        ids, vectors = np.asarray(got["query_id"]), got["q"].combine_chunks()
        sizes = np.asarray(pa.compute.list_value_length(vectors))
        asked = {}
        for dims in np.unique(sizes):
            q = np.asarray(vectors.filter(pa.array(sizes == dims)).flatten(), float).reshape(-1, dims)
            own = ids[sizes == dims]
            none = np.full((len(own), k), np.inf)
            asked[dims] = [own, q / np.linalg.norm(q, axis=1)[:, None], none, np.zeros(none.shape, np.int64)]
        for batch in batches:
            lengths = np.asarray(pa.compute.list_value_length(batch.column("v")))
            for dims, state in asked.items():
                own, q, best, who = state
                step = max(1, CELLS // len(own))
                at = np.flatnonzero(lengths == dims)
                for lo in range(0, len(at), step):
                    some = at[lo : lo + step]
                    v = np.asarray(batch.column("v").take(pa.array(some)).flatten(), float).reshape(len(some), dims)
                    rows = np.asarray(batch.column("id"))[some]
                    distance = np.round(1 - q @ (v / np.linalg.norm(v, axis=1)[:, None]).T, 6)
                    distance[own[:, None] == rows[None, :]] = np.inf
                    distance, rows = np.hstack([best, distance]), np.hstack([who, np.broadcast_to(rows, distance.shape)])
                    order = np.lexsort((rows, distance), axis=1)[:, :k]
                    best, who = np.take_along_axis(distance, order, 1), np.take_along_axis(rows, order, 1)
                state[2:] = best, who
        for own, _, best, who in asked.values():
            kept = best < np.inf
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, kept.sum(1))), pa.array(who[kept]), pa.array(best[kept])], ["query_id", "id", "distance"])

    return run


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, wanted, hit) of every query with neighbours: how many of the true ones were found."""
    right = truth.select("query_id", "id").join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return right.groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("hit").alias("hit"))
