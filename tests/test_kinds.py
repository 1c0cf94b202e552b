import pytest

from barloom.operators import chan
from barloom.sources import walk_bars
from barloom.sources.tables import written


@pytest.mark.parametrize("dialect", ["P", "C"])
def test_a_wanted_kind_is_what_all_kinds_hold_of_it(spark, sf, dialect):
    bars = written(walk_bars(spark, sf), "walk")
    rows = lambda frame: sorted(map(tuple, frame.collect()))
    whole = rows(chan.structures(bars, dialect))
    for kind in {x[1] for x in whole}:
        assert rows(chan.structures(bars, dialect, kinds=(kind,))) == [x for x in whole if x[1] == kind]


def test_what_no_wanted_kind_needs_is_not_made(monkeypatch):
    """Strokes need no directions, merged bars no fractals."""

    def never(*_):
        raise AssertionError

    x = {"date": list(range(60)), **{c: [10.0 + (i * 7 % 11) + k for i in range(60)] for k, c in enumerate(("low", "open", "close", "high"))}}
    monkeypatch.setattr(chan, "directions", never)
    assert {r[0] for r in chan._rows_p(x, chan.RULES["pullback"], 1, ("stroke",))} == {"stroke"}
    for name in ("fractals_c", "macd_seeded"):
        monkeypatch.setattr(chan, name, never)
    assert {r[0] for r in chan._rows_c(x, ("merged",))} == {"merged"}


@pytest.mark.parametrize("reach", [1, 2])
def test_fractals_equal_a_slow_model(reach):
    high = [float(i * 7 % 5 + i * 3 % 4) for i in range(50)]
    m = chan.Merged(high, [h - 1 - i % 2 for i, h in enumerate(high)], [], [], [], [], [])
    want = []
    for i in range(reach, 50 - reach):
        near = [j for j in range(i - reach, i + reach + 1) if j != i]
        top, bottom = all(m.high[i] > m.high[j] for j in near), all(m.low[i] < m.low[j] for j in near)
        want += [(i, chan.TOP if top else chan.BOTTOM)] if top != bottom else []
    assert chan.fractals_p(m, reach) == want and want
    assert chan.fractals_p(chan.Merged([1.0] * reach, [1.0] * reach, [], [], [], [], []), reach) == []
