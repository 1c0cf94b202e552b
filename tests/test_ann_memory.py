"""What a task of the vector index holds at once does not grow with the rows of its batches."""

import numpy as np
import pyarrow as pa

from barloom.operators import ann


class Shared:
    def __init__(self, value):
        self.value = value


class Spark:
    class sparkContext:
        broadcast = staticmethod(Shared)


def index(rng, lists, parts=4, dims=8):
    made = ann.Index.__new__(ann.Index)
    made.spark, made.centroids, made.books = Spark, rng.normal(size=(lists, dims)).astype(np.float32), rng.normal(size=(parts, 16, dims // parts)).astype(np.float32)
    return made


def test_scores_leave_in_bounded_batches():
    rng = np.random.default_rng(1)
    rows = [(0, rng.integers(0, 1 << 40, 256).tobytes(), rng.integers(0, 16, (256, 4), np.uint8).tobytes(), list(range(32)), rng.normal(size=256).astype(np.float32)) for _ in range(40)]
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float32()))
    batch = pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(map(list, zip(*rows)), kinds)], ["list", "ids", "codes", "asked", "q"])
    sizes = [x.num_rows for x in index(rng, 1)._scored(200)([batch])]
    assert sum(sizes) == 40 * 32 * 200 and max(sizes) < ann.ROWS + 32 * 200


def test_exact_neighbours_leave_once_a_task():
    rng = np.random.default_rng(2)
    v, n = rng.integers(-2, 3, (3000, 4)) + 0.5, 100
    asked = pa.table({"query_id": np.arange(n), "q": pa.array(list(v[:n]), pa.list_(pa.float64()))})
    batches = pa.table({"id": np.arange(3000), "v": pa.array(list(v), pa.list_(pa.float64()))}).to_batches(max_chunksize=700)
    got = pa.Table.from_batches(ann._brute(Shared(asked), 10)(batches)).to_pylist()
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    want = []
    for q in range(n):
        distance = np.round(1 - unit[q] @ unit.T, 6)
        want += [(q, i) for i in [i for i in np.lexsort((np.arange(3000), distance)) if i != q][:10]]
    assert len(got) == n * 10
    assert sorted((r["query_id"], r["id"]) for r in got) == sorted(want)
