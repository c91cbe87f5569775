"""Top N items of every group, by a hot-cold split.

Exact counts per group are taken first (map-side combined, one small row per
group).  Groups above ``heavy_rows`` rows are *hot*: their rows are salted
by score range and by a hash of the tie columns, each (group, range, salt) slice
keeps its own best N, and only those few rows meet again in the group's
final sort.  A cold group is one slice, an ordinary window.  Both go through one pass over the rows and end in the
same total order, so the result is exact.

Defined cases: a null group key is a group of its own; rows with a null score
rank last, NaN ranks above all numbers; rows equal in all order columns are repeats of one item and come out
once; ties follow the later order columns; an empty input gives an empty
result; extra columns are carried along, one named like the place gets an
underscore.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.plans.durable import broadcast_if_small, cut, row_bytes
from tracewright.plans.names import carried

#: A group with more rows than this never meets in one task before it is reduced.
HEAVY_ROWS = 50_000
RANGES = 32
SALTS = 8


def _order(order: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order]


def _ranked(df: DataFrame, parts: list[str], order: list[Column], n: int, place: str) -> DataFrame:
    """Rows within the first ``n`` distinct order tuples; equal tuples share a place."""
    return df.withColumn(place, F.dense_rank().over(Window.partitionBy(*parts).orderBy(*order))).where(F.col(place) <= n)


def top_n_per_group(
    df: DataFrame,
    keys: list[str],
    order: list[tuple[str, bool]],
    n: int,
    *,
    place: str = "place",
    heavy_rows: int = HEAVY_ROWS,
    ranges: int = RANGES,
    salts: int = SALTS,
) -> DataFrame:
    """The ``n`` best rows of each group, ``order`` = [(column, descending), ...].

    ``order`` must end in a column that tells items apart; rows equal in all of
    it are repeats of one item and come out once.  The first order column must be numeric.
    """
    fixed = [*keys, *[c for c, _ in order]]
    free = [c for c in df.columns if c not in fixed]
    own = carried(free, [*fixed, place])
    df = df.withColumnsRenamed(dict(zip(free, own, strict=True)))
    score = order[0][0]
    cols = _order(order)
    flags = ["__range", "__salt"]
    heavy = cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > heavy_rows).drop("__rows"))
    n_heavy = heavy.count()  # at most rows / heavy_rows

    def finish(x: DataFrame) -> DataFrame:
        return _ranked(x, keys, cols, n, place).dropDuplicates([*keys, place])

    if n_heavy == 0:
        return finish(df)

    # splitters of the score inside each hot group: mergeable sketch, one row per hot group
    side = broadcast_if_small(heavy, n_heavy)
    hot = df.join(side, reduce(lambda a, b: a & b, [df[k].eqNullSafe(heavy[k]) for k in keys]), "left_semi")
    splits = cut(
        hot.groupBy(*keys).agg(
            F.percentile_approx(F.col(score).cast("double"), [i / ranges for i in range(1, ranges)], 1000).alias("__splits"), F.lit(True).alias("__hot")
        )
    )
    renamed = splits.select(*[F.col(k).alias(f"__k_{i}") for i, k in enumerate(keys)], "__splits", "__hot")
    on = reduce(lambda a, b: a & b, [df[k].eqNullSafe(renamed[f"__k_{i}"]) for i, k in enumerate(keys)])
    ties = [c for c, _ in order[1:]] or [score]
    # hot and cold in one pass: a cold group is one slice, its range and salt are null
    sliced = (
        df.join(broadcast_if_small(renamed, n_heavy, 64 + 8 * ranges + row_bytes(renamed.schema)), on, "left")
        .withColumn("__range", F.when(F.col("__hot"), F.coalesce(F.size(F.filter("__splits", lambda s: s < F.col(score))), F.lit(-1))))
        .withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*ties), F.lit(salts))))
        .drop("__splits", "__hot", *[f"__k_{i}" for i in range(len(keys))])
    )
    best = _ranked(sliced, [*keys, *flags], cols, n, place).drop(place, *flags)
    return finish(best)
