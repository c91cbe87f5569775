"""Semi joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.plans.durable import fits

#: Rows of one key that are not sent to one task.
HOT_ROWS = 100_000


def keep_keys(big: DataFrame, keys: DataFrame, on: str, n_keys: int, count: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows of ``big`` whose key is in ``keys`` (``n_keys`` distinct ones, ``count`` tells the rows of each in ``big``).

    Few keys are broadcast.  Of many, the hot ones, at most rows / ``hot_rows``, are; their rows stay where they are, and
    only the rest is shuffled.
    """
    if fits(keys.select(on), n_keys):
        return big.join(F.broadcast(keys.select(on)), on, "left_semi")
    hot = keys.where(F.col(count) > hot_rows).select(on)
    side = F.broadcast(hot) if fits(hot, hot.count()) else hot
    rest = big.join(side, on, "left_anti").join(keys.where(F.col(count) <= hot_rows).select(on), on, "left_semi")
    return big.join(side, on, "left_semi").unionByName(rest)
