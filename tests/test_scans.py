import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from barloom.operators import enhanced, folds, pullback, scans

SCHEMA = "symbol long, date date, high double, low double, close double, ema12 double, block int"


def bars(spark, n, seed=1, holes=(), symbols=2):
    rows = []
    for s in range(symbols):
        rng, p = random.Random(seed + s), 100.0
        for i in range(n):
            p = max(5.0, p * (1 + rng.gauss(0, 0.02)))
            rows.append((s, dt.date(1990, 1, 1) + dt.timedelta(days=i), p * 1.01, p * 0.99, None if i in holes else p, -1.0, 3))
    return spark.createDataFrame(rows, SCHEMA)


def slow(own: pd.DataFrame) -> dict:
    """The indicators of one symbol with pandas' own exponential means."""
    high, low, close = (own[c] for c in ("high", "low", "close"))
    mean = lambda x, alpha: x.ewm(alpha=alpha, adjust=False).mean()
    out = {"ema12": mean(close, 2 / 13), "ema26": mean(close, 2 / 27)}
    out["diff"] = out["ema12"] - out["ema26"]
    out["dea"] = mean(out["diff"].where(close.notna()), 2 / 10) if close.isna().any() else mean(out["diff"], 2 / 10)
    out["bar"] = 2 * (out["diff"] - out["dea"])
    move = close.diff()
    up, down = mean(move.clip(lower=0), 1 / 14), mean((-move).clip(lower=0), 1 / 14)
    out["rsi"] = 100 - 100 / (1 + up / down)
    out |= dict(zip(scans.SEEDED, folds.macd_seeded(close.to_numpy())))
    out["atr"] = folds.atr(high.to_numpy(), low.to_numpy(), close.to_numpy())
    rise, fall = high.diff().clip(lower=0), (-low.diff()).clip(lower=0)
    base = pd.Series(folds.true_range(high.to_numpy(), low.to_numpy(), close.to_numpy())).rolling(14).mean()
    plus, minus = (100 * x.ewm(alpha=1 / 14).mean() / base for x in (rise, fall))
    out["adx"] = (100 * (plus - minus).abs() / (plus + minus).replace(0, np.nan)).rolling(14).mean()
    return {k: np.asarray(v, float) for k, v in out.items()}


def compare(spark, frame, wanted):
    got = scans.indicators(frame, wanted).toPandas().sort_values(["symbol", "date"])
    for symbol, own in frame.toPandas().sort_values("date").groupby("symbol"):
        want, have = slow(own.reset_index(drop=True)), got[got["symbol"] == symbol]
        for name in wanted:
            a, b = have[name].to_numpy(float), want[name]
            assert (np.isnan(a) == np.isnan(b)).all(), name
            assert np.allclose(a, b, rtol=1e-9, atol=1e-9, equal_nan=True), name


@pytest.mark.parametrize("n", [1, 2, 14, 15, 26, 34, 60, 3000])
def test_windows_equal_the_recursion(spark, n):
    """3000 rows are five to thirteen blocks of each mean."""
    compare(spark, bars(spark, n), scans.KINDS)


def test_missing_closes_leave_means_as_they_are(spark):
    frame = bars(spark, 900, holes={0, 1, 7, 8, 200, 201, 202, 203, 600})
    compare(spark, frame, ["ema12", "ema26", "diff"])
    compare(spark, bars(spark, 900, holes={3, 400}), ["rsi"])


def test_constant_and_empty_tables(spark):
    still = spark.createDataFrame([(1, dt.date(2020, 1, 1) + dt.timedelta(days=i), 5.0, 5.0, 5.0, None, None) for i in range(60)], SCHEMA)
    last = scans.indicators(still).orderBy("date").tail(1)[0]
    assert (last.ema12, last.diff, last.rsi, last.atr, last.adx) == (pytest.approx(5.0), pytest.approx(0.0), None, 0.0, None)
    assert scans.indicators(still.limit(0)).count() == 0
    rising = spark.createDataFrame([(1, dt.date(2020, 1, 1) + dt.timedelta(days=i), 5.0 + i, 4.0 + i, 5.0 + i, None, None) for i in range(60)], SCHEMA)
    assert scans.indicators(rising, ["rsi"]).orderBy("date").tail(1)[0].rsi == pytest.approx(100)


def test_plans_hold_no_python_and_one_exchange_by_symbol(spark):
    plan = scans.indicators(bars(spark, 5))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "hashpartitioning" in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_buys_as_windows_equal_the_walk(spark):
    """Swings around rising and falling averages, so that near, far and missing lows all decide."""
    rows = []
    for s in range(12):
        rng, p = random.Random(s), 10.0
        for i in range(600):
            p = max(2.0, p * (1 + rng.gauss(0.002 if (i // 40) % 3 else -0.003, 0.05)))
            rows.append((s, dt.date(2000, 1, 1) + dt.timedelta(days=i), p * (1 + rng.random() / 20), p * (1 - rng.random() / 20), p, None if rng.random() < 0.01 else 1000.0))
    frame = spark.createDataFrame(rows, "symbol long, date date, high double, low double, close double, volume double")
    walked = {(r.symbol, r.date, r.peak, r.low) for r in pullback.enhanced(frame).where("action = 'BUY'").collect()}
    assert len(walked) > 50 and {tuple(r) for r in enhanced.buys(frame).collect()} == walked
    assert enhanced.buys(frame.limit(0)).count() == 0
