"""Merged bars, fractals and strokes of dialect P where one symbol's history is cut into blocks.

A fold over bars is cut by running every block from some start state.  At first no block but the first one knows its own;
each then takes the state that the block before ended with, and is run again where that differs from what it had begun
with, until no end changes.  So the first round, whose ends but those of first blocks are guesses anyway, looks only at the
last bars of each block.  The folds forget quickly (the next bar that no other contains, or the next fractal that
begins a stroke, decides alone what follows), so two rounds settle nearly all blocks; a block that does not forget passes its
change on, so the result always equals one fold over the whole history.  States are a few numbers a block.

What only looks at neighbours (directions, fractals) is windows over the merged bars.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators import chan
from barloom.sources.tables import scratch

BLOCK = 1 << 16
STATE = "symbol long, block long, state array<double>"
BARS = ("high", "low", "open", "close")
MERGED = "symbol long, high double, low double, open double, close double, row long, at long, trend int, row_date int, at_date int"
STROKES = "symbol long, start_seq long, end_seq long, type string, start_date int, end_date int, start_price double, end_price double, high double, low double, value double"

#: (columns of one block in order, its start state or None, whether it is the last, whether rows are wanted) -> (rows out, end state)
Run = Callable[[dict[str, list], list | None, bool, bool], tuple[list[tuple], list]]
ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}
HELD = 1 << 14  # rows out that are passed on together
GUESS = 4  # the first round runs this part of a block


def _blocks(batches) -> Iterator[tuple[dict[str, list], list | None]]:
    """(columns, start state) of every block from batches of rows in the order of fold; only the block at hand is held over."""
    held = None
    for batch in chain(batches, [None]):
        if batch is not None:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
        elif held is None:
            return
        else:
            rows = held
        keys = [rows[c].to_numpy() for c in ("symbol", "block")]
        cuts = (np.flatnonzero((keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])) + 1).tolist() if len(rows) else []
        ends = cuts if batch is not None else [*cuts, len(rows)]
        done = ends[-1] if ends else 0
        columns = {c: rows[c].slice(0, done).to_numpy().tolist() for c in rows.column_names if c != "state"}
        held = rows.slice(done)
        for i, j in zip([0, *ends], ends):
            state = rows["state"][i].as_py()
            if j > i + (state is not None):  # a state alone belongs to a block that is not asked for
                yield {c: x[i + (state is not None) : j] for c, x in columns.items()}, state


def _passed(rows: DataFrame, starts: DataFrame | None, made: Callable[[dict[str, list], list | None], list[tuple]], out: str) -> DataFrame:
    """The rows that ``made`` gives for every block: blocks stream through tasks, each after a row that holds its start state."""
    names = [c.split()[0] for c in out.split(", ")]
    types = [ARROW[c.split()[1]] for c in out.split(", ")]

    def run(batches):
        found = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), types)], names)
        for own, state in _blocks(batches):
            found += made(own, state)
            if len(found) >= HELD:
                yield pack()
                found = []
        if found:
            yield pack()

    both = rows.withColumn("state", F.lit(None).cast("array<double>"))
    if starts is not None:
        fill = [F.lit(0).cast(f.dataType).alias(f.name) for f in rows.schema if f.name not in ("symbol", "block")]
        both = both.unionByName(starts.select("symbol", "block", *fill, "state"))
    return both.repartition("symbol", "block").sortWithinPartitions("symbol", "block", F.col("state").isNull(), "k").mapInArrow(run, out)


def fold(rows: DataFrame, run: Run, out: str, block: int) -> tuple[DataFrame, int]:
    """(rows out of all blocks, rounds until the states had settled); rows: symbol, k (from 0 without gaps) and the columns of run, numbers without nulls."""
    spark = rows.sparkSession
    path = scratch(spark, "blocks")
    cut = rows.withColumn("block", F.floor(F.col("k") / block)).withColumn("end", F.max("block").over(Window.partitionBy("symbol")))
    cut.write.parquet(path)
    cut = spark.read.parquet(path)
    keys = ["symbol", "block"]
    part = lambda own, state, wanted: run(own, state, own["block"][0] == own["end"][0], wanted)
    ends = lambda own, state: [(own["symbol"][0], own["block"][0], part(own, state, False)[1])]
    whole = lambda own, state: part(own, state, True)[0]

    before = cut.where("block < end")  # ends of the last blocks start nothing
    starts, known, rounds = None, spark.createDataFrame([], STATE), 0
    asked = None  # all of them
    while (before if asked is None else asked).limit(1).count():
        tails = (F.col("block") == 0) | (F.col("k") % block >= block - -(-block // GUESS))
        again = _passed(before.where(tails) if asked is None else before.join(asked, keys, "left_semi"), starts, ends, STATE)
        made = scratch(spark, "states")
        (again if asked is None else again.unionByName(known.join(asked, keys, "left_anti"))).write.parquet(made)
        new, rounds = spark.read.schema(STATE).parquet(made), rounds + 1
        starts = new.withColumn("block", F.col("block") + 1)
        old = known.withColumn("block", F.col("block") + 1).withColumnRenamed("state", "old")
        changed = starts.join(old, keys, "left").where(~F.col("state").eqNullSafe(F.col("old"))).select(keys)
        asked, known = changed.join(new.select(keys), keys, "left_semi"), new  # every block but the last ones has an end
    return _passed(cut, starts, whole, out), rounds


def _merge(own: dict[str, list], state: list | None, last: bool, wanted: bool):
    first, days = own["k"][0], own["day"]
    start = chan.Merged(*([x] for x in (*state[:4], int(state[4]), int(state[5]), int(state[6])))) if state else None
    m = chan.merge_p(*(own[c] for c in BARS), start, first)
    day = lambda at, held: days[at - first] if at >= first else int(held)
    held = state[7:] if state else (None, None)
    n, rows = len(m.high), []
    for i in range(0 if wanted else n - 1, n):
        rows.append((m.high[i], m.low[i], m.open[i], m.close[i], m.row[i], m.at[i], m.trend[i], day(m.row[i], held[0]), day(m.at[i], held[1])))
    done = rows if last else rows[:-1]
    return [(own["symbol"][0], *r) for r in done], [float(x) for x in rows[-1]]


def merged(bars: DataFrame, block: int = BLOCK) -> tuple[DataFrame, int]:
    """(merged bars with seq, rounds); rows with a null price are left out first."""
    rows = bars.dropna(subset=list(BARS)).select("symbol", "date", F.unix_date("date").alias("day"), *[F.col(c).cast("double").alias(c) for c in BARS])
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy("date")).cast("long") - 1)
    found, rounds = fold(rows.drop("date"), _merge, MERGED, block)
    return _dated(found, "row_date", "at_date").withColumn("seq", F.row_number().over(Window.partitionBy("symbol").orderBy("row")).cast("long") - 1), rounds


def _dated(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.date_from_unix_date(c) for c in columns})


def directed(found: DataFrame, backtest: bool = False) -> DataFrame:
    """merged bars with ``way``: see chan.directions."""
    w = Window.partitionBy("symbol").orderBy("seq")

    def against(h1, l1, h2, l2):
        return F.when((h2 > h1) & (l2 > l1), 1).when((h2 < h1) & (l2 < l1), -1).otherwise(0)

    high, low = F.col("high"), F.col("low")
    back, ahead = against(F.lag("high").over(w), F.lag("low").over(w), high, low), against(high, low, F.lead("high").over(w), F.lead("low").over(w))
    if backtest:
        return found.withColumn("way", F.when(F.col("seq") > 0, back).otherwise(ahead))
    colour = F.when(F.col("close") >= F.col("open"), 1).otherwise(-1)
    return found.withColumn("way", F.when((F.col("seq") > 0) & (back != 0), back).when(ahead != 0, ahead).otherwise(colour))


def fractals(found: DataFrame, reach: int = 1) -> DataFrame:
    """The merged bars that are strict extremes over ``reach`` bars on both sides: kind (1 top, -1 bottom), price, n (from 0)."""
    w = Window.partitionBy("symbol").orderBy("seq")
    before, after = w.rowsBetween(-reach, -1), w.rowsBetween(1, reach)
    whole = (F.count("*").over(before) == reach) & (F.count("*").over(after) == reach)
    top = (F.col("high") > F.max("high").over(before)) & (F.col("high") > F.max("high").over(after))
    bottom = (F.col("low") < F.min("low").over(before)) & (F.col("low") < F.min("low").over(after))
    rows = found.withColumns({"whole": whole, "top": top, "bottom": bottom}).where("whole and top <> bottom")
    rows = rows.withColumn("kind", F.when(F.col("top"), 1).otherwise(-1)).withColumn("price", F.when(F.col("top"), F.col("high")).otherwise(F.col("low")))
    return rows.withColumn("n", F.row_number().over(w).cast("long") - 1).drop("whole", "top", "bottom")


def _strokes(rule: chan.StrokeRule) -> Run:
    width = 6  # numbers of a fractal in the state

    def run(own: dict[str, list], state: list | None, last: bool, wanted: bool):
        held = [tuple(state[i + 1 : i + 1 + width]) if state[i] else None for i in (0, 1 + width)] if state else [None, None]
        at = chan.StrokeFold(rule, *held)
        found = []
        for f in zip(own["seq"], own["kind"], own["high"], own["low"], own["day"], own["at"]):
            found += at.push(tuple(map(float, f)))
        found += at.close() if last else []
        price = lambda f: f[2] if f[1] == chan.TOP else f[3]
        rows = [(own["symbol"][0], int(a[0]), int(b[0]), "up" if b[1] == chan.TOP else "down", int(a[4]), int(b[4]), price(a), price(b), max(a[2], b[2]), min(a[3], b[3]), b[5]) for a, b in found * wanted]
        return rows, [x for f in (at.run, at.at) for x in (0.0 if f is None else 1.0, *(f or (0.0,) * width))]

    return run


def strokes(found: DataFrame, rule: str = "pullback", block: int = BLOCK) -> tuple[DataFrame, int]:
    """(strokes with seq, rounds) from fractals()."""
    rows = found.select("symbol", F.col("n").alias("k"), "seq", "kind", "high", "low", F.unix_date("row_date").alias("day"), "at")
    out, rounds = fold(rows, _strokes(chan.RULES[rule]), STROKES, block)
    return _dated(out, "start_date", "end_date").withColumn("seq", F.row_number().over(Window.partitionBy("symbol").orderBy("end_seq")).cast("long") - 1), rounds
