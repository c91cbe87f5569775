"""Redelivered rows once, without shuffling rows that came once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.plans.durable import broadcast_if_small, cut, fits


def _repeated(df: DataFrame, key: str) -> tuple[DataFrame, int]:
    """The keys that come more than once, and how many these are; the keys alone are counted."""
    found = cut(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(key))
    return found, found.count()


def once(df: DataFrame, key: str) -> DataFrame:
    """``df`` with one row per key; repeats must be equal rows but for columns that do not matter.

    The keys alone are counted first.  Rows of keys that came once stay where they are; only the others are
    shuffled, or all rows if too many keys repeat to be broadcast.  Rows with a null key are all kept.
    """
    known = F.col(key).isNotNull()
    repeated, n = _repeated(df, key)
    if n == 0:
        return df
    if not fits(repeated, n):
        return df.where(known).dropDuplicates([key]).unionByName(df.where(~known))
    side = F.broadcast(repeated)
    return df.join(side, key, "left_anti").unionByName(df.join(side, key, "left_semi").dropDuplicates([key]))


def marked_repeats(df: DataFrame, key: str, mark: str) -> DataFrame:
    """``df`` with a text column ``mark``: the key where it comes more than once, else null.

    So rows that are gathered by something else, but equal repeats with them, can be told apart there.
    """
    repeated, n = _repeated(df, key)
    if n == 0:
        return df.withColumn(mark, F.lit(None).cast("string"))
    side = repeated.select(F.col(key).alias("__again"))
    return df.join(broadcast_if_small(side, n), F.col(key) == F.col("__again"), "left").withColumn(mark, F.col("__again").cast("string")).drop("__again")
