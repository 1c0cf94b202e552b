import datetime as dt
import random


from barloom.streaming import state

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, value double, n int"



def run(spark, tmp_path, name, batches, **options):
    """The rows that a stream makes of batches in turn; a last event far ahead settles all."""
    end = [(10**9, dt.datetime(2030, 1, 1), -1, 0.0, 0)]
    for k, batch in enumerate([*batches, end]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k:02d}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = state.settled(stream, **options).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return spark.table(name)


def shuffled(events, delay, every):
    """Batches in order of arrival; an event arrives up to ``delay`` days after its time."""
    rng = random.Random(6)
    start = min(e[1] for e in events)
    out: dict = {}
    for e in sorted(events, key=lambda e: rng.random()):
        out.setdefault(int(((e[1] - start).total_seconds() / 86400 + rng.random() * delay) // every), []).append(e)
    return [out[k] for k in sorted(out)]


def test_shuffled_arrival_equals_the_window(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/events.parquet")
    events = [(r.event_id, r.ts, None if r.event_id % 17 == 3 else r.user_id % 8, None if r.event_id % 11 == 0 else r.value, 1) for r in table.where("event_id % 3 = 0").collect()]
    batches = shuffled(events, 1.9, 8)
    assert len(batches) >= 4 and any(a[1] > b[1] for a, b in zip([e for x in batches for e in x], [e for x in batches for e in x][1:]))
    got = run(spark, tmp_path, "settled_now", batches, late="2 days", width=4)
    want = state.settled(spark.createDataFrame(events, SCHEMA), width=4)
    key = lambda r: tuple((x is not None, x) if x is not None else (False, 0) for x in r)
    assert sorted(map(key, (tuple(r) for r in rows_any(got)))) == sorted(map(key, (tuple(r) for r in rows_any(want))))


def rows_any(frame):
    return [(r.user_id, r.event_id, r.ts, round(r.total, 6), None if r.mean is None else round(r.mean, 6), r.week, r.open, r.high, r.low, r.n) for r in frame.collect() if r.user_id != -1]


def test_a_key_that_is_idle_is_forgotten(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    batches = [[(1, day(0), 1, 5.0, 0), (2, day(0), 2, 5.0, 0)], [(3, day(3), 2, 7.0, 0)], [(4, day(9), 2, 1.0, 0)], [(5, day(11), 1, 2.0, 0), (6, day(11), 2, 2.0, 0)]]
    got = {r.event_id: r.total for r in run(spark, tmp_path, "idle_now", batches, late="1 day", idle_ms=7 * 86_400_000).collect()}
    got = {k: v for k, v in got.items() if k < 10}
    assert got == {1: 5.0, 2: 5.0, 3: 12.0, 4: 13.0, 5: 2.0, 6: 15.0}
    table = spark.createDataFrame([e for x in batches for e in x], SCHEMA)
    assert {r.event_id: r.total for r in state.settled(table, idle_ms=7 * 86_400_000).collect()} == got


def slow(events, width):
    """(user, event) -> (total, mean, week's open, high, low, n) by plain loops."""
    out, by_user = {}, {}
    for e in sorted(events, key=lambda e: (e[1], e[0])):
        by_user.setdefault(e[2], []).append(e)
    for user, own in by_user.items():
        for i, e in enumerate(own):
            seen = [x[3] for x in own[: i + 1]]
            last = [x for x in seen[-width:] if x is not None]
            week = [x[3] for x in own[: i + 1] if x[1].isocalendar()[:2] == e[1].isocalendar()[:2]]
            known = [x for x in week if x is not None]
            out[(user, e[0])] = (sum(x or 0 for x in seen), sum(last) / len(last) if last else None, *((known[0], max(known), min(known)) if known else (None,) * 3), len(week))
    return out


def test_windows_equal_a_slow_model(spark):
    rng = random.Random(2)
    events = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(900)), rng.choice([None, 1, 2]), rng.choice([None, float(rng.randrange(50))]), 0) for i in range(200)]
    want = slow(events, 3)
    for r in state.settled(spark.createDataFrame(events, SCHEMA), width=3).collect():
        total, mean, *bar = want[(r.user_id, r.event_id)]
        assert (r.total, None if r.mean is None else round(r.mean, 9), r.open, r.high, r.low, r.n) == (total, None if mean is None else round(mean, 9), *bar)
    assert state.settled(spark.createDataFrame([(1, None, 1, 2.0, 0)], SCHEMA)).count() == 0
    assert state.settled(spark.createDataFrame([], SCHEMA)).count() == 0
