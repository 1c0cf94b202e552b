import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom import functions as fn
from barloom import sources
from barloom.operators import asof, bars, chan, chunking, folds, fundamentals, pullback, strategies, text
from barloom.plans import learning, sequences
from barloom.sources import tables
from barloom.streaming import bars as streaming

D = dt.date


def values(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, number", [("1.2亿", 1.2e8), ("3,456万", 3.456e7), ("--", None), (" 12.5 ", 12.5), ("n/a", None), ("abc", None), ("", None), (None, None), ("NaN", None)])
def test_parse_number(spark, text, number):
    assert values(spark, fn.parse_number(F.lit(text).cast("string"))) == number


def test_lookup_number(spark):
    assert values(spark, fn.lookup_number(F.lit('{"净利润":"--","扣非净利润":"x","归属净利润":"2万"}'), "净利润")) == 2e4
    assert values(spark, fn.lookup_number(F.lit('{"净利润":"5","归属净利润":"2万"}'), "净利润")) == 5
    assert values(spark, fn.lookup_number(F.lit("{}"), "净利润")) is None


@pytest.mark.parametrize("day, friday, month_end", [
    (D(2025, 5, 30), D(2025, 5, 30), D(2025, 5, 30)), (D(2025, 5, 31), D(2025, 6, 6), D(2025, 6, 30)), (D(2025, 8, 30), D(2025, 9, 5), D(2025, 9, 30)), (D(2025, 8, 4), D(2025, 8, 8), D(2025, 8, 29)),
])
def test_period_labels(spark, day, friday, month_end):
    assert values(spark, fn.week_friday(F.lit(day))) == friday
    assert values(spark, fn.business_month_end(F.lit(day))) == month_end


def test_drop_repeated_lines(spark):
    text = "\n".join(["head", "a", "head ", "b", " head", "x" * 101, "x" * 101, "x" * 101, "twice", "twice", ""])
    kept = values(spark, fn.drop_repeated_lines(F.lit(text)))
    assert kept == "\n".join(["a", "b", "x" * 101, "x" * 101, "x" * 101, "twice", "twice", ""])
    assert values(spark, fn.drop_repeated_lines(F.lit("a\nb"))) == "a\nb"


def test_upsert_and_as_of(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, bars.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    left = spark.createDataFrame([(1, D(2025, 1, 8)), (1, D(2025, 1, 9)), (1, D(2025, 1, 1)), (2, D(2025, 1, 8))], "symbol int, date date")
    right = spark.createDataFrame([(1, D(2025, 1, 1), 5.0), (1, D(2025, 1, 2), None)], "symbol int, date date, close double")
    got = {(r.symbol, r.date.day): r.close for r in asof.as_of(left, right, "symbol", "date", "close", 7).collect()}
    assert got == {(1, 8): 5.0, (1, 9): None, (1, 1): 5.0, (2, 8): None}


def walk(n, seed=1):
    rng = random.Random(seed)
    out, p = [], 100.0
    for _ in range(n):
        o, p = p, max(5.0, p * (1 + rng.gauss(0, 0.02)))
        out.append((o, max(o, p) * (1 + rng.random() / 100), min(o, p) * (1 - rng.random() / 100), p))
    o, h, lo, c = zip(*out)
    return h, lo, o, c


def test_merge_p_inclusion():
    m = chan.merge_p([10, 11, 10.5, 12], [8, 9, 9.5, 10], [8, 9, 10, 10], [9, 11, 10, 12])
    assert (m.high, m.low, m.row, m.trend) == ([10, 11, 12], [8, 9, 10], [0, 2, 3], [0, 1, 1])
    m = chan.merge_p([10, 9, 9.5], [8, 7, 6], [9, 8, 8], [8, 7, 7])
    assert (m.high, m.low, m.at) == ([10, 9], [8, 6], [0, 1])
    assert chan.merge_p([10, 11], [8, 7], [9, 9], [9, 9]).high == [11]


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize("rule", chan.RULES)
def test_sequences_hold_invariants(seed, rule):
    m = chan.merge_p(*walk(400, seed))
    for i in range(1, len(m.high)):
        assert not chan._inside(m.high[i - 1], m.low[i - 1], m.high[i], m.low[i])
        assert m.trend[i] != 0
    for a, b in chan.strokes_p(m, chan.fractals_p(m), chan.RULES[rule]):
        assert a[1] != b[1] and b[0] - a[0] - 1 >= chan.RULES[rule].gap
    m = chan.merge_c(*walk(400, seed))
    strokes = chan.strokes_c(m, chan.fractals_c(m))
    assert all(x[1] == y[0] and x[1][1] != y[1][1] for x, y in zip(strokes, strokes[1:]))
    items = chan.legs(m, strokes)
    assert all(lower < upper for _, _, upper, lower in chan.pivots(items))
    assert all(b - a >= 2 and (b - a) % 2 == 0 for a, b in chan.segments(items))


def test_directions_by_rule():
    m = chan.merge_p([10, 11, 12, 11.5, 12.5], [8, 9, 8.5, 8.2, 9], [9, 10, 11, 11, 9], [10, 9, 10, 9, 12])
    assert chan.directions(m)[0] == 1 and chan.directions(m, True)[0] == 1
    lone = chan.merge_p([10], [8], [9], [8.5])
    assert chan.directions(lone) == [-1] and chan.directions(lone, True) == [0]
    wide = chan.Merged([10, 12], [8, 7], [9, 9], [9, 10], [0, 1], [0, 1], [0, 0])
    assert chan.directions(wide) == [1, 1] and chan.directions(wide, True) == [0, 0]


def test_report_by_hand(spark):
    rows = spark.createDataFrame([(1.0, 1.0)] * 3 + [(1.0, 0.0)] + [(0.0, 0.0)] * 2 + [(0.0, 1.0)] * 2, "label double, prediction double")
    got = {r["class"]: (r.support, r.precision, r.recall, r.f1) for r in learning.report(rows).collect()}
    assert got == {1.0: (4, 0.6, 0.75, round(2 * 0.6 * 0.75 / 1.35, 9)), 0.0: (4, round(2 / 3, 9), 0.5, round(2 * 2 / 3 * 0.5 / (2 / 3 + 0.5), 9))}


def test_strokes_by_rule():
    high, low = [5, 6, 9, 7, 6, 8, 10, 9, 8], [3, 4, 7, 5, 4, 6, 8, 7, 6]
    m = chan.merge_p(high, low, low, high)
    marks = chan.fractals_p(m)
    assert marks == [(2, 1), (4, -1), (6, 1)]
    assert [(a[0], b[0]) for a, b in chan.strokes_p(m, marks, chan.RULES["pullback"])] == [(2, 4), (4, 6)]
    assert chan.strokes_p(m, marks, chan.RULES["backtest"]) == []


def leg(sign, start, end, row):
    return chan.Leg(sign, start, end, max(start, end), min(start, end), row, row + 5)


def test_pivot_and_third_buy():
    items = [leg(1, 1, 10, 0), leg(-1, 10, 5, 5), leg(1, 5, 9, 10), leg(-1, 9, 6, 15), leg(1, 6, 20, 20), leg(-1, 20, 15, 25)]
    zones = chan.pivots(items[:4])
    assert zones == [(0, 3, 9, 5)]
    assert chan.points(items, zones, []) == [("3B", 30, 15)]


def test_first_and_second_points():
    """First points from consolidation divergences alone, second ones from the first pullback that keeps the level."""
    fall = [leg(-1, 20, 10, 0), leg(1, 10, 15, 5), leg(-1, 15, 8, 10), leg(1, 8, 14, 15), leg(-1, 14, 9, 20)]
    assert chan.points(fall, [], [("consolidation_bottom", 0, 2, -5.0, -3.0)]) == [("1B", 15, 8), ("2B", 25, 9)]
    assert chan.points(fall, [], [("trend_bottom", 0, 2, -5.0, -3.0)]) == []
    lower = [*fall[:4], leg(-1, 14, 7, 20)]
    assert chan.points(lower, [], [("consolidation_bottom", 0, 2, -5.0, -3.0)]) == [("1B", 15, 8)]
    rise = [leg(1, 5, 10, 0), leg(-1, 10, 7, 5), leg(1, 7, 12, 10), leg(-1, 12, 8, 15), leg(1, 8, 11, 20)]
    assert chan.points(rise, [], [("consolidation_top", 0, 2, 5.0, 3.0)]) == [("1S", 15, 12), ("2S", 25, 11)]
    higher = [*rise[:4], leg(1, 8, 13, 20)]
    assert chan.points(higher, [], [("consolidation_top", 0, 2, 5.0, 3.0)]) == [("1S", 15, 12)]
    assert chan.points(rise, [], []) == []


def test_third_sell():
    items = [leg(1, 4, 9, 0), leg(-1, 9, 5, 5), leg(1, 5, 8, 10), leg(-1, 8, 3, 15), leg(1, 3, 4, 20)]
    assert chan.points(items, [(0, 2, 9, 5)], []) == [("3S", 25, 4)]
    back = [*items[:4], leg(1, 3, 6, 20)]  # it returns into the pivot
    assert chan.points(back, [(0, 2, 9, 5)], []) == []


def test_folds_match_a_slow_model():
    x = np.array(walk(80, 3)[3])
    y = [x[0]]
    for v in x[1:]:
        y.append(y[-1] * (1 - 2 / 13) + v * 2 / 13)
    assert np.allclose(folds.ema(x, 2 / 13), y)
    line, signal, hist = folds.macd_seeded(x)
    assert np.isnan(hist[:33]).all() and not np.isnan(hist[33:]).any()
    assert np.isclose(hist[33], line[33] - signal[33])
    h, lo, _, c = map(np.array, walk(80, 3))
    a = folds.atr(h, lo, c)
    assert np.isnan(a[:14]).all() and np.isclose(a[14], folds.true_range(h, lo, c)[1:15].mean())


def series(spark, closes, start=D(2024, 1, 1)):
    rows = [(1, start + dt.timedelta(days=i), c * 0.995, c * 1.01, c * 0.99, float(c), 1000.0, 1000.0 * c) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol long, date date, open double, high double, low double, close double, volume double, amount double")


def pullback_path():
    flat = [10 + 0.02 * i for i in range(40)] + [10.6, 10.3, 10.0, 9.7, 9.9, 10.2, 10.5]
    up = [10.5 * 1.08**i for i in range(1, 10)]
    wave = [up[-1] * x for x in (0.92, 0.86, 0.8, 0.84, 0.88, 0.86, 0.84)]
    return flat + up + wave + [up[-1] * 0.86 * (1 + 0.002 * i) for i in range(18)]


def traded_path(tail):
    return [8 + 0.01 * i for i in range(200)] + pullback_path() + [pullback_path()[-1] * x for x in tail]


def test_backtest_accounts_balance(spark):
    path = traded_path((1.02, 1.05, 1.1, 1.2, 1.3, 1.2, 1.0, 0.8, 0.7))
    rows = series(spark, path)
    trades = pullback.backtest(rows).orderBy("seq").collect()
    assert trades and trades[0].action == "buy" and trades[0].size % 100 == 0
    last = pullback.daily_equity(rows).orderBy("date").collect()[-1]
    assert abs(last.equity - trades[-1].cash - sum(r["size"] for r in trades) * path[-1]) < 1e-6
    cash, size = 1_000_000.0, 0.0
    for r in trades:
        cash -= r["size"] * r.price + r.fee
        size += r["size"]
        assert r.fee >= 5 and abs(cash - r.cash) < 1e-6 and size >= 0


def test_backtest_needs_thirty_weeks(spark):
    assert pullback.backtest(series(spark, pullback_path())).count() == 0


def slow_weekly_mean(days, close, n=30):
    out = []
    for i, day in enumerate(days):
        ends = {}
        for d, c in zip(days[: i + 1], close):
            ends[d.isocalendar()[:2]] = c
        last = list(ends.values())[-n:]
        out.append(sum(last) / n if len(last) == n else None)
    return out


def test_weekly_mean_counts_the_current_week():
    days = [D(2020, 1, 1) + dt.timedelta(days=2 * i) for i in range(150)]
    close = np.array(walk(150, 4)[3])
    got = pullback.weekly_mean(pd.Series(days), close)
    for a, b in zip(got, slow_weekly_mean(days, close)):
        assert (np.isnan(a) and b is None) or np.isclose(a, b)


def test_backtest_exits(spark):
    """The first sell of paths that fall at once, that climb to the peak, and that climb and fall through the risen stop."""
    first = {}
    for name, tail in {"crash": (0.7, 0.6), "climb": (1.02, 1.0, 0.98, 1.0, 1.04, 1.08, 1.12, 1.2, 1.3, 1.4), "drift": tuple(1 - 0.002 * i for i in range(40))}.items():
        trades = pullback.backtest(series(spark, traded_path(tail))).orderBy("seq").collect()
        first[name] = [r.action for r in trades][:2]
        size = 0
        for r in trades:
            size += r["size"]
            assert size >= 0
    assert first["crash"] == ["buy", "stop_average"] or first["crash"] == ["buy", "stop_trail"]
    assert first["climb"][1].startswith("target") or first["climb"][1] == "stop_trail"
    assert first["drift"][1] in ("dead_cross", "stop_trail", "stop_average")


def test_account_statistics(spark):
    days = [D(2020, 1, 2), D(2020, 6, 1), D(2020, 12, 31), D(2021, 6, 1), D(2021, 12, 31)]
    rows = spark.createDataFrame([(1, d, e) for d, e in zip(days, [1_000_000.0, 1_200_000.0, 1_100_000.0, 990_000.0, 1_210_000.0])], "symbol long, date date, equity double")
    got = sequences.account_statistics(rows).first()
    assert got.drawdown == round(1 - 990 / 1200, 6) and got.annual_return == 0.1 and got.sharpe is None
    up = spark.createDataFrame([(1, D(2020, 12, 31), 1_100_000.0), (1, D(2021, 12, 31), 1_430_000.0)], "symbol long, date date, equity double")
    assert sequences.account_statistics(up).first().sharpe == round((0.2 - 0.01) / 0.1, 4)


def slow_enhanced(high, low, close, volume):
    """The buy marks of every bar from the rule as it is written, on the history up to that bar."""
    out = []
    for t in range(len(close)):
        ma = {n: [round(float(np.mean(close[i - n + 1 : i + 1])), 2) if i >= n - 1 else None for i in range(t + 1)] for n in (5, 30)}
        first = 29
        if t < first + 49:
            continue
        peak = None
        for i in range(t - 1, first + 3, -1):
            if high[i] == max(high[max(first, i - 2) : min(t, i + 2) + 1]) and high[i] >= 1.2 * ma[30][i]:
                peak = i
                break
        if peak is None:
            continue
        part = low[peak + 1 : t + 1]
        recent = None
        if len(part) >= 5:
            for j in range(len(part) - 2, 3, -1):
                if part[j] == min(part[max(0, j - 2) : j + 3]):
                    recent = part[j]
                    break
            recent = min(part) if recent is None else recent
        recent = low[t - 1] if recent is None else recent
        slope = np.polyfit(range(5), ma[30][t - 4 : t + 1], 1)[0]
        if slope >= -1e-6 and close[t] > ma[30][t] and ma[5][t] > ma[30][t] and (close[t] - ma[30][t]) / ma[30][t] <= 0.05:
            out.append((t, high[peak], recent))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_enhanced_buy_marks_match_a_slow_model(seed):
    rng = random.Random(seed)
    close = [20.0]
    for i in range(400):
        close.append(close[-1] * (1 + rng.gauss(0.004 if (i // 60) % 2 == 0 else -0.003, 0.035)))
    close = np.array(close)
    high, low = close * (1 + np.array([rng.random() for _ in close]) / 40), close * (1 - np.array([rng.random() for _ in close]) / 40)
    volume = np.array([1000 + 500 * rng.random() for _ in close])
    buys, sells = pullback.enhanced_marks(high, low, close, volume)
    assert buys == slow_enhanced(high, low, close, volume)
    assert all(rule in ("A", "B", "C", "TP1", "TP2", "TP3") for _, rule, _ in sells)
    test_enhanced_buy_marks_match_a_slow_model.seen = getattr(test_enhanced_buy_marks_match_a_slow_model, "seen", 0) + len(buys)


def test_enhanced_sells_in_order():
    n = 4
    flat = {"ma5": np.full(n, 10.0), "ma30": np.full(n, 9.0), "wild": np.full(n, 0.5)}

    def sell(held, high, low, close, volume=(100, 100), **changed):
        a = {**flat, **changed}
        wide = lambda x: np.array([10.0, 10.0, x[0], x[1]] if isinstance(x, tuple) else [10.0, 10.0, 10.0, x])
        return pullback._sell(3, held, wide(high), wide(low), wide(close), wide(volume), a["ma5"], a["ma30"], a["wild"])

    new = lambda **k: {"entry": 10.0, "peak": 12.0, "low": 9.0, "top": 10.0, "stop": np.nan, "hit": 0} | k
    assert sell(new(), 9.0, 8.0, 8.0, (100, 150)) == "A"
    assert sell(new(), 9.0, 9.2, 8.0, (100, 149)) is None
    assert sell(new(), 10.0, 9.5, 10.0, ma5=np.array([10, 10, 9.0, 8.9])) == "B"
    assert sell(new(top=11.0), 10.0, 9.9, 10.0) == "C" and sell(new(stop=9.95), 10.0, 9.9, 10.0) == "C"
    held = new()
    assert sell(held, 10.6, 9.9, 10.2) == "TP1" and sell(held, 10.7, 9.9, 10.2) is None
    assert sell(held, 12.1, 11.8, 12.0) == "TP2" and sell(held, 13.1, 12.9, 13.0) == "TP3"


def test_pullback_finds_the_path(spark):
    daily = series(spark, pullback_path())
    found = pullback.pullback(daily, pullback.DAILY, bars.weekly(daily)).collect()
    assert [r.strategy_name for r in found] == ["AdaptedMAPullback"] and found[0].level > 15
    assert pullback.pullback(series(spark, [10.0] * 60), pullback.DAILY, bars.weekly(daily)).count() == 0


def test_breakout_of_three_peaks(spark):
    path = [12, 10, 14, 20, 30, 22, 16, 14, 18, 24, 20, 16, 13, 15, 19, 16, 13, 12]
    smooth = [float(np.interp(i / 5, range(len(path)), path)) for i in range(5 * (len(path) - 1) + 1)] + [13, 14, 15, 16, 17, 18]
    rows = series(spark, smooth + [18.3, 19.6])
    last = rows.agg(F.max("date")).first()[0]
    rows = rows.withColumn("volume", F.when(F.col("date") == last, 9000.0).otherwise(F.col("volume")))
    found = pullback.breakout(rows).collect()
    assert [r.strategy_name for r in found] == ["ChanBreakout"]
    assert pullback.breakout(series(spark, smooth)).count() == 0


def test_recursive_chunks_by_hand():
    split = chunking.recursive_chunks
    assert split("aa\n\nbb\n\ncc", 5, 0) == ["aa", "bb", "cc"]  # separators stay with what follows
    assert split("aa\n\nbb\n\ncc", 7, 0) == ["aa\n\nbb", "cc"]
    assert split("一二。三四。五六。", 6, 0) == ["一二。三四", "。五六。"]
    assert split("a b c d e f", 5, 2) == ["a b c", "c d", "d e", "e f"]
    assert split("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]
    assert split("ab\n\n\ncdefgh ij", 5, 0) == ["ab", "cdef", "gh", "ij"]
    assert chunking.LADDER[0] == "\n\n\n" and "".join(split("x" * 300, 100, 0)) == "x" * 300


def test_sentence_chunks_by_hand():
    split = chunking.sentence_chunks
    assert split("One. Two. Three.", 9, 0) == ["One. Two.", "Three."]
    assert split("甲。乙。丙。", 5, 2) == ["甲。 乙。", "丙。"]
    assert split("line one\nline two", 9, 4) == ["line one\n", "line two"]  # a newline ends a sentence and a search of the overlap
    assert split("abcdefgh. ijklmnop. q.", 12, 6) == ["abcdefgh.", "ijklmnop. q."]
    assert split("abcdefgh ijklmnop", 10, 2) == ["abcdefgh i", " ijklmnop", "p"]
    assert split("", 10, 2) == []


def test_paragraph_packs_by_hand():
    assert chunking.paragraph_packs("aa\nbb\ncc", 7) == ["\naa\nbb", "cc"]
    assert chunking.paragraph_packs("aa\n" + "b" * 9 + "\nc", 7) == ["\naa", "b" * 9, "c"]
    assert chunking.paragraph_packs("", 7) == ["\n"]


def cleaned(spark, column, text_):
    return spark.createDataFrame([(text_,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_sections_by_hand(spark):
    body = "目录\n管理层讨论......... 12\n第三节 管理层讨论\n正文一。\n 7 \n表......... 3\n正文二。\n\n\n\n末尾\n重要事项\n别的"
    cut = lambda t: text.section(t, text.titles("管理层讨论"), ["公司治理报告", "重要事项"])
    assert cleaned(spark, cut, body) == "正文一。\n\n正文二。\n\n末尾"
    assert "重要事项" not in cleaned(spark, cut, body) and "12" not in cleaned(spark, cut, body) and "......" not in cleaned(spark, cut, body)
    assert cleaned(spark, cut, "管理层讨论\n一直到最后") == "一直到最后" and cleaned(spark, cut, "没有") is None


def test_table_lines_by_hand(spark):
    lines = ["1. 标题 2,345.6", "（一）标题 100", "①  456", "一、概述 100", "完整的一句 12 34 56。", "", "项目   金额", "收入 100 200 300", "这是一段有很多汉字的普通文字   中间有空格", "abc def   ghi jkl mno pqr", "plain words", "only 12"]
    kept = cleaned(spark, text.without_tables, "\n".join(lines)).split("\n")
    assert kept == lines[:6] + [lines[8], "plain words", "only 12"]
    assert cleaned(spark, text.without_tables, "a\n\n\n\nb") == "a\n\nb"


def test_paragraphs_by_hand(spark):
    assert cleaned(spark, text.paragraphs, "第一行\n接着。\n\n第二段 3\n没完\n最后") == "第一行接着。\n第二段 3\n没完最后\n"
    assert cleaned(spark, text.paragraphs, "") == "" and cleaned(spark, text.paragraphs, "see (a)\nb") == "see (a)\nb\n"


def test_questions_by_hand(spark):
    pairs = lambda column, t: [tuple(x) for x in cleaned(spark, column, t)]
    assert pairs(text.questions, "x Q: one A: yes A: more Q: two Q: three A: \n Q:four A:no") == [("one", "yes A: more"), ("four", "no")]
    assert pairs(text.questions, "nothing here") == []
    assert pairs(text.numbered_questions, "前言\n1、公司好吗？\n答:很好\n的。\n2. 明年呢\n不知道\n3、没有答案") == [("公司好吗？", "很好\n的。"), ("明年呢", "不知道")]


def test_chunkers():
    text = "第一句。第二句！" * 200 + "\n\n" + "word " * 900
    for x in (chunking.recursive_chunks(text), chunking.sentence_chunks(text), chunking.paragraph_packs(text, 500)):
        assert x and all(c.strip() for c in x)
    assert all(len(c) <= 2048 for c in chunking.recursive_chunks(text))
    assert all(len(c) <= 1.2 * 450 for c in chunking.sentence_chunks(text))
    assert chunking.recursive_chunks("") == [] and chunking.sentence_chunks("") == []
    assert max(map(len, chunking.recursive_chunks("x" * 5000))) == 2048


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = streaming.event_bars(stream).writeStream.outputMode("complete").format("memory").queryName("bars_now").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(spark.table("bars_now")) == rows(streaming.event_bars(events))


def test_running_state_of_a_stream_equals_the_window(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("value", F.when(F.col("event_id") % 11 != 0, F.col("value")))
    for k in range(3):  # later files hold later events
        events.where(F.floor((F.dayofmonth("ts") - 1) / 11) == k).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    schema = events.schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = streaming.running_state(stream).writeStream.format("memory").queryName("running_now").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    rows = lambda df: {r.event_id: round(r.total, 6) for r in df.collect()}
    assert rows(spark.table("running_now")) == rows(streaming.running_state(events))


def test_unique_events_of_a_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    for k in range(2):
        events.coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = streaming.unique_events(stream).writeStream.format("memory").queryName("unique_now").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [r.event_id for r in spark.table("unique_now").select("event_id").collect()]
    assert sorted(got) == sorted(r.event_id for r in events.select("event_id").collect())


def test_load_bars_asks_for_one_of_two(spark):
    rows = series(spark, [1.0, 2.0, 3.0])
    for bad in ({}, {"start": "2024-01-01", "tail": 2}):
        with pytest.raises(ValueError):
            sources.load_bars(rows, 1, **bad)
    assert [r.close for r in sources.load_bars(rows, 1, tail=2).collect()] == [2.0, 3.0]
    assert [r.close for r in sources.load_bars(rows, 1, end="2024-01-02").collect()] == [1.0, 2.0]


def test_table_versions(spark, tmp_path):
    t = tables.Table(spark, str(tmp_path / "t"))
    make = lambda rows: spark.createDataFrame(rows, "k int, v string")
    with pytest.raises(ValueError):
        t.read()
    t.append(make([(1, "a"), (2, "b")]))
    t.append(make([(2, "c")]))
    assert sorted(map(tuple, t.read().collect())) == [(1, "a"), (2, "b"), (2, "c")]
    assert sorted(map(tuple, t.upsert(make([(2, "d"), (3, "e")]), ["k"]).collect())) == [(2, "d"), (3, "e")]
    t.replace(make([(1, "x"), (1, "y")]), ["k"])
    assert sorted(map(tuple, t.read().collect())) == [(1, "x"), (1, "y"), (2, "d"), (3, "e")]
    t.reload(make([(9, "z")]))
    assert list(map(tuple, t.read().collect())) == [(9, "z")]


def test_report_file(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1,5", None)], "symbol string, pe string, notes string")
    tables.write_report(rows, str(tmp_path / "r"), ["symbol", "missing", "pe", "notes"])
    data = next((tmp_path / "r").glob("part-*.csv")).read_bytes()
    assert data.startswith(b"\xef\xbb\xbfsymbol,missing,pe,notes") and b'a,,"1,5",' in data
    tables.write_report(rows.limit(0), str(tmp_path / "e"), ["symbol"])


def test_point_in_time_metrics(spark):
    """A signal sees no report and no price after its date."""
    data = lambda revenue, profit: f'{{"营业总收入":"{revenue}","净利润":"{profit}"}}'
    quarters = [(D(1997, 12, 31), 100, 10), (D(1998, 3, 31), 50, 5), (D(1998, 12, 31), 200, 20), (D(1999, 3, 31), 75, -5), (D(1999, 12, 31), 300, 30)]
    rows = [(1, "benefit", d, data(r, p)) for d, r, p in quarters] + [(1, "debt", d, f'{{"所有者权益合计":"{r}"}}') for d, r, _ in quarters]
    reports = spark.createDataFrame(rows, "symbol long, report_type string, report_date date, data string")
    bars_ = spark.createDataFrame([(1, D(1998, 6, 1), 2.0), (1, D(1999, 6, 1), 3.0), (1, D(2000, 6, 1), 4.0)], "symbol long, date date, close double")
    shares = spark.createDataFrame([(1, 1000.0)], "symbol long, total_shares double")
    days = [D(1990, 1, 1), D(1998, 6, 8), D(1998, 6, 9), D(1999, 6, 2), D(2000, 6, 1)]
    wanted = spark.createDataFrame([(1, d) for d in days], "symbol long, signal_date date")
    got = {r.signal_date: r for r in fundamentals.analyse(wanted, bars_, reports, shares).collect()}
    assert got[days[0]].report_date is None and got[days[0]].net_profit_positive_3y_latest is False and "Missing price" in got[days[0]].error_reason
    assert got[days[1]].report_date == D(1998, 3, 31) and got[days[1]].pe == 200.0 and got[days[1]].pb == 40.0 and got[days[1]].revenue_growth_yoy is None
    assert got[days[2]].market_cap is None and got[days[2]].report_date == D(1998, 3, 31)
    assert got[days[3]].pe == 150.0 and got[days[3]].revenue_growth_yoy == 0.5 and got[days[3]].profit_growth_yoy == -2.0 and got[days[3]].growth_positive is False
    last = got[days[4]]
    assert last.pe == round(4000 / 30, 4) and last.profit_growth_yoy == 0.5 and last.net_profit_positive_3y_latest is True and last.growth_positive is True


def test_screener_isolates_errors_and_dates(spark):
    daily = series(spark, pullback_path())
    day = daily.agg(F.max("date")).first()[0]

    def broken(frames, day):
        raise RuntimeError("no plan")

    bad = strategies.Strategy("Broken", broken)
    late = strategies.from_marks("Always", lambda rows: rows)
    found = strategies.screen(daily, day, [bad, late, strategies.REGISTRY["AdaptedMAPullback"]]).collect()
    assert sorted((r.strategy_name, r.signal_type) for r in found) == [("AdaptedMAPullback", "BUY"), ("Always", "BUY"), ("Broken", "ERROR")]
    assert strategies.screen(daily, day + dt.timedelta(days=1), [late, strategies.REGISTRY["AdaptedMAPullback"]]).count() == 0
    assert set(strategies.REGISTRY) >= {"AdaptedMAPullback", "MultiLevelCross", "ChanBreakout", "WeeklyMAPullback", "MonthlyMAPullback", "GoldenCross", "Turtle", "TrendLine"}


def test_a_symbol_that_fails_leaves_an_error_row(spark):
    def run(pdf):
        if pdf["symbol"].iloc[0] == 2:
            raise ValueError("bad bars")
        return pd.DataFrame([(1, pdf["date"].max(), "x", "BUY", "Daily", 1.0, 1.0, None)], columns=[c.split()[0] for c in pullback.SIGNALS.split(", ")])

    rows = series(spark, [1.0, 2.0])
    both = rows.union(rows.withColumn("symbol", F.lit(2).cast("long")))
    got = sorted((r.symbol, r.signal_type, r.notes) for r in both.groupBy("symbol").applyInPandas(pullback._isolated(run, "x", "Daily"), pullback.SIGNALS).collect())
    assert got == [(1, "BUY", None), (2, "ERROR", "ValueError: bad bars")]


def period_series(spark, closes, days, start=D(2010, 1, 1)):
    rows = [(1, start + dt.timedelta(days=days * i), c * 0.998, c * 1.004, c * 0.996, c, 1000.0, 1000.0 * c) for i, c in enumerate(map(float, closes))]
    return spark.createDataFrame(rows, "symbol long, date date, open double, high double, low double, close double, volume double, amount double")


HEAD = [10 * 1.004**i for i in range(60)] + [12.5, 12.3, 12.0, 11.8, 12.0, 12.3, 12.6]


def drift(climb, bars_, fall, hold):
    """A ramp, a steep climb, and a slow fall to ``fall`` of the peak that ends in a small rise."""
    up = [HEAD[-1] * climb**i for i in range(1, bars_ + 1)]
    down = np.linspace(up[-1] * 0.98, up[-1] * fall, hold).tolist()
    return HEAD + up + down + [down[-1] * 1.01]


def steep(fall):
    up = [HEAD[-1] * 1.09**i for i in range(1, 7)]
    return HEAD + up + [up[-1] * x for x in (0.98, 0.96, 0.97)] + [up[-1] * fall] * 2


@pytest.mark.parametrize("rule, days, paths", [
    (pullback.WEEKLY, 7, [drift(1.05, 4, fall, hold) for fall in (0.82, 0.84) for hold in (3, 5)]), (pullback.MONTHLY, 30, [steep(fall) for fall in np.arange(0.70, 0.95, 0.01)]),
])
def test_weekly_and_monthly_pullbacks_fire(spark, rule, days, paths):
    hits = []
    for path in paths:
        average = pd.Series(path).rolling(rule.average, min_periods=1).mean().iloc[-1]
        if rule.low * average <= path[-1] * 0.996 <= rule.high * average:
            bars_ = period_series(spark, path, days)
            above = period_series(spark, [5 + 0.05 * i for i in range(60)], 30, D(2006, 1, 1))
            found = pullback.pullback(bars_, rule, above).collect()
            hits += [r.strategy_name for r in found]
            if found and rule.timeframe == "Weekly":  # under the mean of the months, or without one, nothing is bought
                assert pullback.pullback(bars_, rule, period_series(spark, [99 - 0.01 * i for i in range(60)], 30, D(2006, 1, 1))).count() == 0
                assert pullback.pullback(bars_, rule, above.limit(20)).count() == 0
    assert hits and set(hits) == {rule.name}


def test_sections_keep_what_follows(spark):
    cut = lambda t: text.section(t, ["^Of"], ["The", "In"])
    assert cleaned(spark, cut, "x Of y\nOf here\nmore\n  In the end") == "here\nmore"
