"""Sequence structures of bars: merged bars, fractals, strokes, segments, pivots, divergences, points.

Two dialects.  P (pullback, breakout, weekly, monthly, backtest) keeps the trend of merged bars as its merge
direction; C takes the colour of bars.  Kernels work on the columns of one symbol; ``structures`` runs them
for all symbols and returns one flat table, a row per structure.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.operators.folds import macd_seeded

TOP, BOTTOM = 1, -1


@dataclass
class Merged:
    """Columns of merged bars; first and last are row numbers of the bars they come from, at that of the high."""

    high: list
    low: list
    open: list
    close: list
    row: list
    at: list
    trend: list


def _inside(h1, l1, h2, l2) -> int:
    """1: the second bar lies in the first, 2: it holds the first, 0: neither."""
    if h2 <= h1 and l2 >= l1:
        return 1
    return 2 if h2 >= h1 and l2 <= l1 else 0


def merge_p(high, low, open_, close, start: Merged | None = None, first: int = 0) -> Merged:
    """Dialect P: the trend of the last push decides how contained bars join; rows move to the later bar.

    start: what the bars before row ``first`` have left; the bars go on from there.
    """
    m = start or Merged([], [], [], [], [], [], [])
    trend = m.trend[-1] if m.trend else 0
    for i, (h, lo, o, c) in enumerate(zip(high, low, open_, close), first):
        how = _inside(m.high[-1], m.low[-1], h, lo) if m.high else 0
        if not how:
            if m.high:
                trend = int(h > m.high[-1] and lo > m.low[-1]) - int(h < m.high[-1] and lo < m.low[-1])
            for column, value in zip((m.high, m.low, m.open, m.close, m.row, m.at, m.trend), (h, lo, o, c, i, i, trend)):
                column.append(value)
            continue
        if trend > 0 and h >= m.high[-1]:
            m.high[-1], m.at[-1] = h, i
        elif trend < 0:
            m.low[-1] = min(m.low[-1], lo)
        elif trend == 0 and how == 2:
            m.high[-1], m.low[-1], m.at[-1] = h, lo, i
        m.close[-1], m.row[-1] = c, i
    return m


def directions(m: Merged, backtest: bool = False) -> list[int]:
    """Direction against the bar before, else the bar after, else by colour; in the backtest against the bar before alone (the first: after), else 0."""
    def against(i, j):
        return int(m.high[j] > m.high[i] and m.low[j] > m.low[i]) - int(m.high[j] < m.high[i] and m.low[j] < m.low[i])

    n, out = len(m.high), []
    for i in range(n):
        way = against(i - 1, i) if i else 0
        if backtest:
            out.append(way if i or n == 1 else against(0, 1))
            continue
        way = way or (against(i, i + 1) if i + 1 < n else 0)
        out.append(way or (1 if m.close[i] >= m.open[i] else -1))
    return out


def fractals_p(m: Merged, reach: int = 1) -> list[tuple[int, int]]:
    """(merged row, TOP or BOTTOM): strict extremes over ``reach`` bars on both sides."""
    high, low, n = np.array(m.high, float), np.array(m.low, float), len(m.high)
    top, bottom = np.ones(max(0, n - 2 * reach), bool), np.ones(max(0, n - 2 * reach), bool)
    for k in [*range(reach), *range(reach + 1, 2 * reach + 1)] if len(top) else []:
        top &= high[reach : n - reach] > high[k : n - 2 * reach + k]
        bottom &= low[reach : n - reach] < low[k : n - 2 * reach + k]
    return [(int(i) + reach, TOP if top[i] else BOTTOM) for i in np.flatnonzero(top != bottom)]


@dataclass(frozen=True)
class StrokeRule:
    """How fractals join to strokes: collapse runs first ("", "strict", "equal"), the least gap, what an end must pass, whether a close fractal is passed over."""

    collapse: str = ""
    gap: int = 1
    past: str = "near"
    hold: bool = False


RULES = {"pullback": StrokeRule(), "breakout": StrokeRule("equal", 1, "far"), "weekly": StrokeRule("strict", 1), "monthly": StrokeRule("strict", 0), "backtest": StrokeRule("", 2, "near", True)}


def _better(new: tuple, old: tuple, equal: bool) -> bool:
    """Whether a fractal (row, kind, high, low, ...) is more extreme than one of its kind."""
    a, b = (new[2], old[2]) if new[1] == TOP else (-new[3], -old[3])
    return a >= b if equal else a > b


def _passes(m: Merged, new: tuple[int, int], old: tuple[int, int]) -> bool:
    return _better((*new, m.high[new[0]], m.low[new[0]]), (*old, m.high[old[0]], m.low[old[0]]), False)


class StrokeFold:
    """Strokes from fractals (row, kind, high, low, ...) in order; ``run``: the best of the last run of one kind, ``at``: where a stroke may begin."""

    def __init__(self, rule: StrokeRule, run: tuple | None = None, at: tuple | None = None):
        self.rule, self.run, self.at = rule, run, at

    def push(self, f: tuple) -> list[tuple[tuple, tuple]]:
        """The strokes that the next fractal completes."""
        if not self.rule.collapse:
            return self._next(f)
        done = []
        if self.run is None or self.run[1] != f[1]:
            done, self.run = self.close(), f
        elif _better(f, self.run, self.rule.collapse == "equal"):
            self.run = f
        return done

    def close(self) -> list[tuple[tuple, tuple]]:
        """The strokes that the last run completes."""
        last, self.run = self.run, None
        return self._next(last) if last is not None else []

    def _next(self, f: tuple) -> list[tuple[tuple, tuple]]:
        at, rule = self.at, self.rule
        if at is None:
            self.at = f
        elif f[1] == at[1]:
            self.at = f if _better(f, at, False) else at
        elif f[0] - at[0] - 1 < rule.gap:
            self.at = at if rule.hold else f
        else:
            up = f[1] == TOP
            edge = at[2] if (rule.past == "far") == up else at[3]
            good = f[2] > edge if up else f[3] < edge
            self.at = f if good or not rule.hold else at
            return [(at, f)] if good else []
        return []


def strokes_p(m: Merged, fractals: list[tuple[int, int]], rule: StrokeRule) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """(start fractal, end fractal) of every stroke."""
    fold = StrokeFold(rule)
    found = [x for f in fractals for x in fold.push((*f, m.high[f[0]], m.low[f[0]]))] + fold.close()
    return [(a[:2], b[:2]) for a, b in found]


def merge_c(high, low, open_, close) -> Merged:
    """Dialect C: colour decides how contained bars join; rows stay at the first bar."""
    m = Merged([], [], [], [], [], [], [])
    colour = lambda o, c: int(c > o) - int(c < o)
    held = None  # high, low, open, close, row
    for i in range(len(high)):
        bar = [high[i], low[i], open_[i], close[i], i]
        how = _inside(held[0], held[1], bar[0], bar[1]) if held else 0
        if held and how:
            votes = [colour(held[2], held[3])] if how == 1 else [colour(bar[2], bar[3]), colour(held[2], held[3])]
            if m.high:
                votes.append(colour(m.open[-1], m.close[-1]))
            votes.append(1 if (held[3] >= close[i - 1] if how == 1 else bar[3] >= held[3]) else -1)
            pick = max if next(v for v in votes if v) > 0 else min
            held = [pick(held[0], bar[0]), pick(held[1], bar[1]), held[2], bar[3], held[4]]
            continue
        if held:
            _push(m, held)
        held = bar
    if held:
        _push(m, held)
    return m


def _push(m: Merged, bar) -> None:
    for column, value in zip((m.high, m.low, m.open, m.close, m.row, m.at, m.trend), (*bar, bar[4], 0)):
        column.append(value)


def fractals_c(m: Merged) -> list[tuple[int, int]]:
    """Extremes that may tie on one side; of two of a kind within three bars the more extreme stays."""
    out: list[tuple[int, int]] = []
    for i in range(1, len(m.high) - 1):
        around = [(m.high[j], m.low[j]) for j in (i - 1, i + 1)]
        h, lo = m.high[i], m.low[i]
        for kind in (TOP, BOTTOM):
            lead = [(kind * ((h if kind == TOP else lo) - (x[0] if kind == TOP else x[1])), kind * ((lo if kind == TOP else h) - (x[1] if kind == TOP else x[0]))) for x in around]
            if min(min(x) for x in lead) < 0 or not any(a > 0 or (a == 0 and b > 0) for a, b in lead):
                continue
            if out and out[-1][1] == kind and i - out[-1][0] < 3:
                out[-1] = (i, kind) if _passes(m, (i, kind), out[-1]) else out[-1]
            else:
                out.append((i, kind))
    return out


def price(m: Merged, f: tuple[int, int]) -> float:
    return m.high[f[0]] if f[1] == TOP else m.low[f[0]]


def strokes_c(m: Merged, fractals: list[tuple[int, int]]) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Strokes of three bars or more that chain and alternate; a more extreme end of the same kind reopens the last stroke."""
    out: list[tuple[tuple[int, int], tuple[int, int]]] = []
    at, i = None, 0
    while i < len(fractals):
        f = fractals[i]
        if at is None:
            at = f
        elif f[1] == at[1]:
            at = f if _passes(m, f, at) else at
        elif abs(f[0] - at[0]) < 3 or f[1] * (price(m, f) - price(m, at)) <= 0:
            at = f
        elif not out or (at[0] == out[-1][1][0] and f[1] != out[-1][1][1]):
            out.append((at, f))
            at = f
        elif f[1] == out[-1][1][1] and _passes(m, f, out[-1][1]):
            at = out.pop()[0]
            i -= 1
            continue
        else:
            at = f
        i += 1
    return out


@dataclass(frozen=True)
class Leg:
    """A stroke with its extent: sign +1 up, -1 down; begin and end are bar rows."""

    sign: int
    start: float
    end: float
    high: float
    low: float
    begin: int
    last: int


def legs(m: Merged, strokes) -> list[Leg]:
    return [Leg(b[1], price(m, a), price(m, b), max(m.high[a[0] : b[0] + 1]), min(m.low[a[0] : b[0] + 1]), m.row[a[0]], m.row[b[0]]) for a, b in strokes]


def segments(items: list[Leg]) -> list[tuple[int, int]]:
    """(first, last) strokes of segments: three overlapping strokes that break out with a valid pullback, extended by pairs."""
    beyond = lambda s, a, b: s * (a - b) > 0
    out, i = [], 0
    while i + 2 < len(items):
        a, b, c = items[i : i + 3]
        s = a.sign
        good = c.sign == s != b.sign and max(a.low, c.low) < min(a.high, c.high) and beyond(s, c.end, a.end) and beyond(s, b.end, a.start)
        if not good:
            i += 1
            continue
        last = i + 2
        while last + 2 < len(items):
            back, on, before = items[last + 1], items[last + 2], items[last]
            if back.sign == s or on.sign != s or not (beyond(s, on.end, before.end) and beyond(s, back.end, before.start)):
                break
            last += 2
        out.append((i, last))
        i = last + 1
    return out


def pivots(items: list[Leg]) -> list[tuple[int, int, float, float]]:
    """(first, last, upper, lower): three alternating strokes that overlap, extended while strokes interact."""
    out, i = [], 0
    while i + 2 < len(items):
        a, b, c = items[i : i + 3]
        if a.sign == b.sign or b.sign == c.sign:
            i += 1
            continue
        upper, lower = (b.high, max(a.low, c.low)) if a.sign > 0 else (min(a.high, c.high), b.low)
        if lower >= upper:
            i += 1
            continue
        last = i + 2
        while last + 1 < len(items):
            x = items[last + 1]
            if x.sign == items[last].sign or not (x.high >= lower if x.sign > 0 else x.low <= upper):
                break
            group = items[i : last + 2]
            ups, downs = [g.low for g in group if g.sign > 0], [g.high for g in group if g.sign < 0]
            if max(ups) >= min(downs):
                break
            lower, upper, last = max(ups), min(downs), last + 1
        out.append((i, last, upper, lower))
        i = last + 1
    return out


def divergences(items: list[Leg], zones, strength) -> list[tuple[str, int, int, float, float]]:
    """(kind, first, second stroke, strengths): trend pairs two apart, and the first two departures from a pivot."""
    out = []
    for i in range(len(items) - 2):
        a, c = items[i], items[i + 2]
        if a.sign == c.sign != items[i + 1].sign and a.sign * (c.end - a.end) > 0 and a.sign * (strength(c) - strength(a)) < 0:
            out.append(("trend_top" if a.sign > 0 else "trend_bottom", i, i + 2, strength(a), strength(c)))
    for _, last, upper, lower in zones:
        left: dict[int, list[int]] = {1: [], -1: []}
        for k in [k for k, x in enumerate(items) if x.begin >= items[last].last]:
            x = items[k]
            if x.end > upper if x.sign > 0 else x.end < lower:
                left[x.sign].append(k)
            if left[-x.sign]:
                break
        for sign in (-1, 1):
            if len(left[sign]) > 1:
                p, q = left[sign][:2]
                if sign * (items[q].end - items[p].end) > 0 and sign * (strength(items[q]) - strength(items[p])) < 0:
                    out.append(("consolidation_top" if sign > 0 else "consolidation_bottom", p, q, strength(items[p]), strength(items[q])))
    return out


def points(items: list[Leg], zones, found) -> list[tuple[str, int, float]]:
    """(1B .. 3S, bar row, price): first points from consolidation divergences, second from the first pullback, third from a pivot's retest."""
    out = []
    for name, sign in (("B", -1), ("S", 1)):
        first = [(items[q].last, items[q].end) for kind, _, q, _, _ in found if kind == f"consolidation_{'top' if sign > 0 else 'bottom'}"]
        out += [(f"1{name}", row, p) for row, p in first]
        if first:
            row, level = min(first, key=lambda x: x[0])
            later = [x for x in items if x.last > row and x.sign == sign and sign * (level - x.end) > 0]
            if later and later[0].begin > row:
                out.append((f"2{name}", later[0].last, later[0].end))
    for _, last, upper, lower in zones:
        for a, b in zip(items, items[1:]):
            if a.begin < items[last].last:
                continue
            if a.sign > 0 > b.sign and a.low > lower and a.end > upper and b.end > upper:
                out.append(("3B", b.last, b.end))
                break
            if a.sign < 0 < b.sign and a.high < upper and a.end < lower and b.end < lower:
                out.append(("3S", b.last, b.end))
                break
    return sorted(out, key=lambda x: x[1])


STRUCTURES = "symbol long, kind string, seq int, type string, start_date date, end_date date, start_price double, end_price double, high double, low double, value double"


TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "date": pa.int32()}
PRICES = ("high", "low", "open", "close")


def _rows_p(x: dict[str, list], rule: StrokeRule, reach: int, kinds):
    m, day = merge_p(*(x[c] for c in PRICES)), x["date"]
    if "merged" in kinds:
        way = directions(m, rule.hold)
        for i in range(len(m.high)):
            yield "merged", i, str(way[i]), day[m.at[i]], day[m.row[i]], m.open[i], m.close[i], m.high[i], m.low[i], float(m.trend[i])
    if not {"fractal", "stroke"} & set(kinds):
        return
    marks = fractals_p(m, reach)
    for k, f in enumerate(marks if "fractal" in kinds else ()):
        yield "fractal", k, "top" if f[1] == TOP else "bottom", day[m.row[f[0]]], day[m.row[f[0]]], price(m, f), price(m, f), m.high[f[0]], m.low[f[0]], float(f[0])
    for k, (a, b) in enumerate(strokes_p(m, marks, rule) if "stroke" in kinds else ()):
        yield "stroke", k, "up" if b[1] == TOP else "down", day[m.row[a[0]]], day[m.row[b[0]]], price(m, a), price(m, b), max(m.high[a[0]], m.high[b[0]]), min(m.low[a[0]], m.low[b[0]]), float(m.at[b[0]])


def _rows_c(x: dict[str, list], kinds):
    if len(x["date"]) < 35:
        return
    m, day = merge_c(*(x[c] for c in PRICES)), x["date"]
    for i in range(len(m.high) if "merged" in kinds else 0):
        yield "merged", i, "", day[m.row[i]], day[m.row[i]], m.open[i], m.close[i], m.high[i], m.low[i], 0.0
    if not set(kinds) - {"merged"}:
        return
    marks = fractals_c(m)
    for k, f in enumerate(marks if "fractal" in kinds else ()):
        yield "fractal", k, "top" if f[1] == TOP else "bottom", day[m.row[f[0]]], day[m.row[f[0]]], price(m, f), price(m, f), m.high[f[0]], m.low[f[0]], float(f[0])
    if not set(kinds) - {"merged", "fractal"}:
        return
    items = legs(m, strokes_c(m, marks))
    total = np.r_[0.0, np.nancumsum(macd_seeded(np.array(x["close"], float))[2])]
    strength = lambda x: float(total[x.last + 1] - total[x.begin])
    for k, x in enumerate(items if "stroke" in kinds else ()):
        yield "stroke", k, "up" if x.sign > 0 else "down", day[x.begin], day[x.last], x.start, x.end, x.high, x.low, strength(x)
    for k, (a, b) in enumerate(segments(items) if "segment" in kinds else ()):
        part = items[a : b + 1]
        yield "segment", k, "up" if part[0].sign > 0 else "down", day[part[0].begin], day[part[-1].last], part[0].start, part[-1].end, max(x.high for x in part), min(x.low for x in part), float(b - a + 1)
    if not {"pivot", "divergence", "point"} & set(kinds):
        return
    zones = pivots(items)
    for k, (a, b, upper, lower) in enumerate(zones if "pivot" in kinds else ()):
        yield "pivot", k, "", day[items[a].begin], day[items[b].last], items[a].start, items[b].end, upper, lower, float(b - a + 1)
    found = divergences(items, zones, strength)
    for k, (kind, a, b, before, after) in enumerate(found if "divergence" in kinds else ()):
        yield "divergence", k, kind, day[items[a].last], day[items[b].last], items[a].end, items[b].end, before, after, after - before
    for k, (kind, row, level) in enumerate(points(items, zones, found) if "point" in kinds else ()):
        yield "point", k, kind, day[row], day[row], level, level, level, level, 0.0


KINDS = ("merged", "fractal", "stroke", "segment", "pivot", "divergence", "point")


def structures(bars: DataFrame, dialect: str = "P", rule: str = "pullback", reach: int = 1, kinds=KINDS) -> DataFrame:
    """The structures of the wanted kinds of every symbol in one table; rows with a null price are left out first.

    What no wanted kind builds on is not made, and columns pass between Spark and Python as Arrow has them.
    """
    fields = [c.split() for c in STRUCTURES.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        symbol = table["symbol"][0].as_py()
        given = {c: table[c].to_numpy() for c in PRICES} | {"date": table["date"].cast(pa.int32()).to_numpy()}
        whole = ~np.any([np.isnan(given[c].astype(float)) for c in PRICES], axis=0)
        order = np.flatnonzero(whole)[np.argsort(given["date"][whole], kind="stable")]
        x = {c: v[order].tolist() for c, v in given.items()}
        rows = list(_rows_p(x, RULES[rule], reach, kinds) if dialect == "P" else _rows_c(x, kinds)) if len(order) else []
        columns = [[symbol] * len(rows), *(zip(*rows) if rows else [()] * (len(fields) - 1))]
        made = [pa.array(v, TYPES[t]) for v, (_, t) in zip(columns, fields)]
        return pa.table([v.cast(pa.date32()) if t == "date" else v for v, (_, t) in zip(made, fields)], [c for c, _ in fields])

    return bars.select("symbol", "date", "open", "high", "low", "close").groupBy("symbol").applyInArrow(run, STRUCTURES)
