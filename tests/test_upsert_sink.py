import os

import pytest
from pyspark.sql import functions as F

from barloom.streaming.bars import UpsertSink


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "k int, v string, at int, n int")


def rows(sink, spark):
    return sorted(((r.k is not None, r.k, r.v) for r in sink.read(spark).collect()), key=str)


def test_batches_replays_and_missing_epochs(spark, tmp_path):
    sink = UpsertSink(str(tmp_path), ["k"], ["at"], partitions=4, query="a")
    sink(frame(spark, (1, "a", 1, 0), (2, "b", 1, 0), (None, "x", 1, 0)), 0)
    sink(frame(spark, (2, "c", 1, 0), (2, "d", 2, 0)), 1)  # the last by at
    before = rows(sink, spark)
    assert before == [(False, None, "x"), (True, 1, "a"), (True, 2, "d")]
    sink(frame(spark, (1, "late", 9, 0)), 0)  # a batch that was recorded
    sink(frame(spark, (2, "again", 9, 0)), 1)
    assert rows(sink, spark) == before and sink.applied(spark, "a") == 1
    sink(frame(spark, (3, "e", 1, 0), (None, "y", 1, 0)), 5)  # epochs 2 to 4 never came
    assert rows(sink, spark) == [(False, None, "y"), (True, 1, "a"), (True, 2, "d"), (True, 3, "e")] and sink.applied(spark, "a") == 5
    sink(frame(spark), 6)
    assert sink.applied(spark, "a") == 6 and len(rows(sink, spark)) == 4


def test_a_failed_batch_is_merged_again(spark, tmp_path, monkeypatch):
    sink = UpsertSink(str(tmp_path), ["k"], query="a")
    sink(frame(spark, (1, "a", 1, 0), (2, "b", 1, 0)), 0)
    with monkeypatch.context() as m:
        m.setattr(UpsertSink, "_record", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            sink(frame(spark, (2, "c", 1, 0), (3, "d", 1, 0)), 1)
    sink(frame(spark, (2, "c", 1, 0), (3, "d", 1, 0)), 1)
    assert [x[1:] for x in rows(sink, spark)] == [(1, "a"), (2, "c"), (3, "d")]


def test_only_touched_partitions_are_written(spark, tmp_path):
    sink = UpsertSink(str(tmp_path), ["k"], partitions=16, query="a")
    sink(frame(spark, *[(i, "a", 1, 0) for i in range(200)]), 0)
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(tmp_path / "data") for f in names if f.startswith("part-")}
    before = files()
    sink(frame(spark, (7, "b", 1, 0)), 1)
    gone = before - files()
    assert len(before) == 16 and len(gone) == 1 and len(files()) == 16
    assert len(rows(sink, spark)) == 200


def test_a_query_with_a_new_checkpoint_goes_on_with_the_table(spark, tmp_path):
    sink = UpsertSink(str(tmp_path / "t"), ["k"])
    schema = frame(spark).schema

    def run(checkpoint):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        assert q.awaitTermination(180) and q.exception() is None
        return str(q.id)

    for n, batch in enumerate([[(1, "a", 1, 0), (2, "b", 1, 0)], [(2, "c", 1, 0)]]):
        frame(spark, *batch).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
    first = run("c1")
    assert sink.applied(spark, first) == 1
    frame(spark, (3, "d", 1, 0)).coalesce(1).write.parquet(str(tmp_path / "in" / "p2"))
    assert run("c1") == first and sink.applied(spark, first) == 2  # a restart goes on
    assert [x[1:] for x in rows(sink, spark)] == [(1, "a"), (2, "c"), (3, "d")]
    sink.read(spark).where(F.col("k") == 1).count()
    second = run("c2")  # epochs begin at 0 again, on the old table
    assert second != first and sink.applied(spark, second) == 2
    assert [x[1:] for x in rows(sink, spark)] == [(1, "a"), (2, "c"), (3, "d")]
