"""Exponential means over arrays, for the grouped functions that walk through one symbol's bars; scans has them as windows."""

from __future__ import annotations

import numpy as np
import pandas as pd


def ema(x, alpha: float) -> pd.Series:
    """y0 = x0, then (1 - alpha) * y + alpha * x."""
    return pd.Series(x).ewm(alpha=alpha, adjust=False).mean()


def seeded_ema(x: np.ndarray, n: int, begin: int, alpha: float | None = None) -> np.ndarray:
    """EMA whose first value, at row begin, is the mean of the n rows up to it; null before."""
    out = np.full(len(x), np.nan)
    if begin < len(x):
        out[begin:] = ema(np.r_[np.mean(x[begin - n + 1 : begin + 1]), x[begin + 1 :]], 2 / (n + 1) if alpha is None else alpha)
    return out


def macd_seeded(close: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, signal, histogram) with mean-seeded averages that all begin where the slow one can."""
    line = seeded_ema(close, fast, slow - 1) - seeded_ema(close, slow, slow - 1)
    first = slow + signal - 2
    sig = np.full(len(close), np.nan)
    if first < len(close):
        sig[slow - 1 :] = seeded_ema(line[slow - 1 :], signal, signal - 1)
    shown = np.arange(len(close)) >= first
    return np.where(shown, line, np.nan), sig, np.where(shown, line - sig, np.nan)


def true_range(high, low, close) -> np.ndarray:
    before = np.r_[np.nan, close[:-1]]
    return np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))


def atr(high, low, close, n: int = 14) -> np.ndarray:
    """Wilder's average of the true range: begins at row n with the mean of rows 1 to n."""
    return seeded_ema(true_range(high, low, close), n, n, 1 / n)
