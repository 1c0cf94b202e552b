import re

from barloom.operators import chan_blocks
from barloom.sources import dealt_bars


def test_trades_are_dealt_before_they_are_aggregated(spark, sf):
    """The sorts of the aggregation hold a bounded number of trades too, not a share of all by spark.sql.shuffle.partitions."""
    trades = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    plan = dealt_bars(spark, sf, 100)._jdf.queryExecution().executedPlan().toString()
    assert [int(n) for n in re.findall(r"hashpartitioning\(symbol#\d+L?, date#\d+, (\d+)\)", plan)] == [-(-trades // 400)]


def test_ends_of_blocks_are_found_without_their_rows():
    own = {"symbol": [1] * 3, "block": [0] * 3, "k": [0, 1, 2], "day": [5, 6, 7], "high": [2.0, 3.0, 4.0], "low": [1.0, 2.0, 3.0], "open": [1.0] * 3, "close": [2.0] * 3}
    rows, end = chan_blocks._merge(own, None, True, True)
    assert len(rows) == 3 and chan_blocks._merge(own, None, False, False) == ([], end)
