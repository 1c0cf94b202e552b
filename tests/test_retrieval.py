import random

import numpy as np
import pytest

from barloom.operators import ann

SCHEMA = "vec_id long, embedding array<double>, score float, list int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1.0, 3) for i, v in rows], SCHEMA)


def clustered(n, dims=16, groups=12, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims)) * 4
    which = np.where(rng.random(n) < 0.35, 0, rng.integers(0, groups, n))  # one group has more than a third of all rows
    return [(i, (centres[g] + rng.normal(size=dims)).tolist()) for i, g in enumerate(which)]


def true_neighbours(rows, asked, k=10):
    x = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    return {q: [i for _, i in sorted((round(1 - float(x[q] @ v), 6), i) for i, v in x.items() if i != q)[:k]] for q in asked}


def asked(frame, every):
    return frame.where(f"vec_id % {every} = 0").selectExpr("vec_id AS query_id", "embedding AS q")


def test_index_finds_most_neighbours(spark, tmp_path):
    rows = clustered(3000)
    frame = vectors(spark, rows).repartition(5)
    index = ann.Index.build(frame, str(tmp_path / "i"), parts=8)
    files = spark.read.parquet(str(tmp_path / "i" / "lists"))
    assert files.agg({"n": "sum"}).first()[0] == 3000  # every row is in a list
    assert files.agg({"n": "max"}).first()[0] <= ann.BLOCK
    truth = true_neighbours(rows, range(0, 3000, 100))
    found: dict = {}
    for r in sorted(index.search(asked(frame, 100), frame).collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r.id)
    assert sum(len(set(found[q]) & set(truth[q])) for q in truth) >= 0.9 * 10 * len(truth)
    brute: dict = {}
    for r in sorted(ann.exact(frame, asked(frame, 100)).collect(), key=lambda r: (r.query_id, r["rank"])):
        brute.setdefault(r.query_id, []).append(r.id)
    assert brute == truth
    whole = index.search(asked(frame, 500), frame, probes=len(index.centroids), refine=300).collect()  # all lists and candidates: exact
    assert {(r.query_id, r["rank"], r.id) for r in whole} == {(q, n + 1, i) for q in range(0, 3000, 500) for n, i in enumerate(truth[q])}
    assert sorted(map(tuple, ann.recall(index.search(asked(frame, 500), frame, probes=len(index.centroids), refine=300), ann.exact(frame, asked(frame, 500))).collect())) == [(q, 10, 10) for q in range(0, 3000, 500)]
    again = ann.Index(spark, str(tmp_path / "i"))  # a reader of the files
    assert (again.centroids == index.centroids).all() and again.probes(0.9) <= again.probes(0.98) <= len(again.centroids)


def test_index_reads_the_probed_lists_only(spark, tmp_path):
    frame = vectors(spark, clustered(2000))
    index = ann.Index.build(frame, str(tmp_path / "i"), parts=4, lists=16)
    plan = index.candidates(asked(frame, 2000), 2, 20)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan
    lists = {r.list for r in index.probed(asked(frame, 2000), 2).collect()}
    assert len(lists) == 2


def test_index_on_odd_tables(spark, tmp_path):
    rng = random.Random(4)
    good = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    odd = [(900, None), (901, [None] * 8), (902, [float("nan")] * 8), (903, [0.0] * 8), (904, [1.0] * 4), (905, []), (None, [1.0] * 8), (906, [float("inf")] * 8), (5, good[5][1]), (907, [1e200] * 8)]
    frame = vectors(spark, good + odd)
    index = ann.Index.build(frame, str(tmp_path / "i"), parts=4)
    got = index.search(asked(frame, 50), frame, probes=99, refine=30).collect()
    assert {r.query_id for r in got} == {0, 50, 100, 150, 200, 250} and all(r.id < 300 for r in got)
    assert index.search(asked(frame, 5000).where("false"), frame).count() == 0
    with pytest.raises(ValueError, match="no vector"):
        ann.Index.build(vectors(spark, odd[:4]), str(tmp_path / "j"))
    with pytest.raises(ValueError, match="parts"):
        ann.Index.build(frame, str(tmp_path / "k"), parts=3)
    one = vectors(spark, good[:1])
    alone = ann.Index.build(one, str(tmp_path / "l"), parts=4)
    assert alone.search(asked(one, 1), one).count() == 0 and ann.exact(one, asked(one, 1)).count() == 0
