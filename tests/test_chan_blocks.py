import datetime as dt
import random

import pytest

from barloom.operators import chan, chan_blocks

SCHEMA = "symbol long, date date, open double, high double, low double, close double, block long, state int, k int"
D = dt.date(1900, 1, 1)


def walk(n, seed):
    rng, out, p = random.Random(seed), [], 100.0
    for _ in range(n):
        o, p = p, max(5.0, round(p * (1 + rng.gauss(0, 0.02)), 2))
        out.append((o, round(max(o, p) * (1 + rng.random() / 100), 2), round(min(o, p) * (1 - rng.random() / 100), 2), p))
    return out


def narrowing(n):
    """Every bar lies in the one before: one merged bar that no block forgets, then a break."""
    return [(50.0, 100.0 - i / n * 40, 1.0 + i / n * 40, 51.0) for i in range(n)] + [(200.0, 210.0, 190.0, 205.0), (5.0, 9.0, 4.0, 6.0), (200.0, 210.0, 190.0, 205.0)]


def bars(spark, by_symbol):
    rows = [(s, D + dt.timedelta(days=i), *x, 7, 7, 7) for s, path in by_symbol.items() for i, x in enumerate(path)]
    return spark.createDataFrame(rows, SCHEMA)


def whole(path, reach, rule):
    opens, highs, lows, closes = ([x[i] for x in path] for i in range(4))
    m = chan.merge_p(highs, lows, opens, closes)
    marks = chan.fractals_p(m, reach)
    return m, marks, chan.strokes_p(m, marks, chan.RULES[rule])


@pytest.mark.parametrize("block, reach, rule", [(1, 1, "pullback"), (7, 2, "breakout"), (50, 1, "weekly"), (13, 1, "backtest"), (1 << 16, 1, "monthly")])
def test_blocks_equal_the_whole_fold(spark, block, reach, rule):
    paths = {1: walk(300, 1)[: 12 if block == 1 else 300], 2: walk(45, 2)[: 45 if block > 1 else 5], 3: narrowing(4 * block if block < 20 else 60), 4: walk(1, 3)}
    frame = bars(spark, paths)
    found, rounds = chan_blocks.merged(frame, block)
    found = found.cache()
    marks = chan_blocks.fractals(found, reach).cache()
    strokes, _ = chan_blocks.strokes(marks, rule, max(2, block // 4))
    got = {name: {} for name in ("merged", "marks", "strokes")}
    for r in chan_blocks.directed(found, chan.RULES[rule].hold).orderBy("seq").collect():
        got["merged"].setdefault(r.symbol, []).append((r.high, r.low, r.open, r.close, r.row, r.at, r.trend, r.way, (r.row_date - D).days, (r.at_date - D).days))
    for r in marks.orderBy("n").collect():
        got["marks"].setdefault(r.symbol, []).append((r.seq, r.kind))
    for r in strokes.orderBy("seq").collect():
        got["strokes"].setdefault(r.symbol, []).append((r.start_seq, r.end_seq, r.start_price, r.end_price))
    for s, path in paths.items():
        m, fx, sk = whole(path, reach, rule)
        way = chan.directions(m, chan.RULES[rule].hold)
        assert got["merged"][s] == [(*x, w, r, a) for *x, w, r, a in zip(m.high, m.low, m.open, m.close, m.row, m.at, m.trend, way, m.row, m.at)]
        assert got["marks"].get(s, []) == fx
        assert got["strokes"].get(s, []) == [(a[0], b[0], chan.price(m, a), chan.price(m, b)) for a, b in sk]
    assert rounds == 0 if block == 1 << 16 else rounds > 2 or block > 20  # the narrowing bars pass their state through block after block


def test_rounds_are_few_on_a_long_history(spark):
    """One symbol of 40,000 bars in 50 blocks."""
    path = walk(40_000, 9)
    found, rounds = chan_blocks.merged(bars(spark, {1: path}), 800)
    m, fx, sk = whole(path, 1, "pullback")
    assert rounds <= 3
    assert [(r.high, r.low, r.row) for r in found.orderBy("seq").collect()] == list(zip(m.high, m.low, m.row))
    strokes, rounds = chan_blocks.strokes(chan_blocks.fractals(found), "pullback", 200)
    assert rounds <= 4 and [(r.start_seq, r.end_seq) for r in strokes.orderBy("seq").collect()] == [(a[0], b[0]) for a, b in sk]


def test_nulls_and_nothing(spark):
    path = walk(30, 4)
    frame = bars(spark, {1: path})
    frame = frame.union(spark.createDataFrame([(1, D + dt.timedelta(days=100), None, 1.0, 1.0, 1.0, 7, 7, 7), (2, D, 1.0, None, 1.0, 1.0, 7, 7, 7)], SCHEMA))
    m = whole(path, 1, "pullback")[0]
    assert [(r.high, r.low) for r in chan_blocks.merged(frame, 4)[0].orderBy("seq").collect()] == list(zip(m.high, m.low))
    found, rounds = chan_blocks.merged(frame.limit(0), 4)
    assert found.count() == 0 and rounds == 0 and chan_blocks.strokes(chan_blocks.fractals(found), "weekly", 4)[0].count() == 0


def test_blocks_stream_across_batches():
    """Blocks come whole from batches cut anywhere, each with the state that its first row holds; a state without bars is left out."""
    import pyarrow as pa

    rows = [(1, 0, None, 0), (1, 0, None, 1), (1, 1, [2.0], 0), (1, 1, None, 2), (2, 0, None, 0), (2, 5, [1.0], 0), (3, 1, [3.0], 0), (3, 1, None, 9)]
    want = [(1, [0, 1], None), (1, [2], [2.0]), (2, [0], None), (3, [9], [3.0])]
    for size in (1, 3, 8):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in p], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.int64()))], ["symbol", "block", "state", "k"]) for p in parts]
        assert [(own["symbol"][0], own["k"], state) for own, state in chan_blocks._blocks(iter(batches))] == want
    assert list(chan_blocks._blocks(iter([]))) == []
