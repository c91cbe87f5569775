"""Exact percentiles per group by bisection over mergeable summaries.

A *summary* tells how often each value occurs in a group.
Summaries of separate partitions, days or slices are combined by adding
their counts, so percentiles of the whole need no second look at raw rows.

For each (group, percentile) an interval of values is kept that holds the reading
at the target rank.  A pass counts the readings below the interval's midpoint and keeps the half in which
the rank falls, tightened to the smallest and largest value seen there; rows outside of it drop out of the next pass.
The result is the reading at rank ceil(q*n) itself: the error is zero.

Groups of ordinary size are sent to one task each, once, and bisected there, all groups of the task side by side
(:func:`bisect`).  Hot groups never meet in one task: their counts per value are bisected by passes over the cluster,
``2**BITS`` cells at a time, of which only the counts are shuffled, and the rows left are kept apart after each pass.

Defined cases: null, NaN and infinite values are no readings; a null key is
a group of its own; a group without readings does not appear; repeated rows of one item count once when
``item`` is given, rows without an item all count; an empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracewright.plans.durable import broadcast_if_small, cut, discard
from tracewright.plans.names import carried
from tracewright.plans.once import marked_repeats

#: Bisection steps fused into one counting pass over a hot group.
BITS = 8
#: Cells per doubling of the value in the first pass over a hot group.
LOG_STEPS = 8
#: A group with more rows than this never meets in one task.
HEAVY_ROWS = 50_000


@dataclass(frozen=True)
class Summary:
    """Counts per group and value, and the names of the group keys.

    The frame is (k0, k1, ..., v, n, again): a value may have several rows; of rows of a group with an equal ``again`` only one counts.
    """

    frame: DataFrame
    keys: list[str]

    @property
    def own(self) -> list[str]:
        return [f"k{i}" for i in range(len(self.keys))]

    def compact(self) -> Summary:
        """One row per group and value, to be kept."""
        own = [*self.own, "v"]
        told = self.frame.groupBy(*own, "again").agg(F.sum("n").alias("n"), F.min("n").alias("one"))
        counted = told.withColumn("n", F.when(F.col("again").isNull(), F.col("n")).otherwise(F.col("one")))
        return Summary(counted.groupBy(*own).agg(F.sum("n").alias("n")).withColumn("again", F.lit(None).cast("string")), self.keys)


def summarize(df: DataFrame, keys: list[str], value: str, item: str | None = None, again: str | None = None) -> Summary:
    """How often each value occurs in each group.  Mergeable with :func:`combine`.

    With ``item``, repeated rows of one item, which must be equal, count once; a caller who has marked repeats by :func:`marked_repeats`
    names the mark as ``again`` instead.
    """
    own = [f"k{i}" for i in range(len(keys))]
    named = [F.col(k).alias(o) for k, o in zip(keys, own, strict=True)]
    more = [F.col(item).alias("item")] if item else [F.col(again).alias("again") if again else F.lit(None).cast("string").alias("again")]
    rows = df.select(*named, F.col(value).cast("double").alias("v"), *more).where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf")))
    if item:
        rows = marked_repeats(rows, "item", "again")
    return Summary(rows.select(*own, "v", F.lit(1).cast("long").alias("n"), "again"), list(keys))


def combine(*summaries: Summary) -> Summary:
    """The summary of the union of what the given summaries describe."""
    return Summary(reduce(DataFrame.unionByName, [s.frame for s in summaries]), summaries[0].keys)


def roll_up(summary: Summary, keys: list[str]) -> Summary:
    """The summary by fewer keys: days, slices or whatever else is left out are combined."""
    kept = [F.col(o).alias(f"k{keys.index(k)}") for k, o in zip(summary.keys, summary.own, strict=True) if k in keys]
    return Summary(summary.frame.select(*kept, "v", "n", "again"), list(keys))


def ranks_of(q: float, n: np.ndarray) -> np.ndarray:
    """Target ranks, from 1; the small allowance keeps 0.95 * 100 at 95."""
    return np.maximum(1, np.ceil(q * n - 1e-9)).astype(np.int64)


def _ordered_bits(v: np.ndarray) -> np.ndarray:
    """Unsigned whole numbers in the order of the doubles; -0.0 counts as 0.0."""
    bits = (v + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def bisect(group: np.ndarray, v: np.ndarray, n: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The value at rank ``target`` of each group; rows lie in order of ``group`` (0, 1, ...), ``v`` occurs ``n`` times."""
    key, weight = _ordered_bits(v), n.astype(float)
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    low, high = np.minimum.reduceat(key, starts), np.maximum.reduceat(key, starts)
    at, below = np.arange(len(key)), np.zeros(len(target))
    while True:
        at = at[(low < high)[group[at]]]  # of the intervals still open
        if not len(at):
            break
        g = group[at]
        middle = low + (high - low) // np.uint64(2)
        under = key[at] <= middle[g]
        counted = np.bincount(g, weight[at] * under, len(target))
        left = below + counted >= target
        kept = under == left[g]
        below = np.where(left, below, below + counted)
        at, g = at[kept], g[kept]
        heads = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        low[g[heads]], high[g[heads]] = np.minimum.reduceat(key[at], heads), np.maximum.reduceat(key[at], heads)
    bits = np.where(low >> np.uint64(63), low & np.uint64((1 << 63) - 1), ~low)
    return bits.view(np.float64)


def _of_groups(rows: DataFrame, own: list[str], qs: list[float], at_least: int) -> DataFrame:
    """Percentiles of groups that fit a task, each bisected where it was sent."""
    schema = T.StructType(
        [*[rows.schema[o] for o in own], T.StructField("q", T.DoubleType()), T.StructField("n_readings", T.LongType()), T.StructField("value", T.DoubleType())]
    )
    arrow = to_arrow_schema(schema)

    def starts_of(table: pa.Table) -> np.ndarray:
        fresh = np.zeros(table.num_rows, bool)
        fresh[0] = True
        for o in own:
            codes = table[o].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            fresh[1:] |= codes[1:] != codes[:-1]
        return np.flatnonzero(fresh)

    def settle(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        v, n = table["v"].to_numpy(), table["n"].to_numpy()
        if table["again"].null_count < len(v):
            at = np.flatnonzero(table["again"].is_valid().to_numpy())
            marks = pd.DataFrame({"g": np.searchsorted(starts, at, "right"), "again": table["again"].take(pa.array(at)).to_pandas()})
            n = n.copy()
            n[at[marks.duplicated().to_numpy()]] = 0
        sizes = np.add.reduceat(n, starts)
        wanted = sizes >= at_least
        group = np.repeat(np.cumsum(wanted) - 1, np.diff(np.append(starts, len(v))))
        use = np.repeat(wanted, np.diff(np.append(starts, len(v))))
        heads, total = starts[wanted], sizes[wanted]
        if not len(heads):
            return pa.RecordBatch.from_pylist([], schema=arrow)
        found = np.concatenate([bisect(group[use], v[use], n[use], ranks_of(q, total)) for q in qs])
        keys = table.select(own).take(pa.array(np.tile(heads, len(qs))))
        return pa.RecordBatch.from_arrays(
            [*[keys[o].combine_chunks() for o in own], pa.array(np.repeat(np.array(qs, float), len(heads))), pa.array(np.tile(total, len(qs))), pa.array(found)], schema=arrow
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            starts = starts_of(table)
            last = int(starts[-1])
            if last:
                yield settle(table.slice(0, last), starts[:-1])
            held = table.slice(last)  # one group at most
        if held is not None:
            yield settle(held, np.zeros(1, np.int64))

    h = F.xxhash64(*own)
    return rows.repartition(*own).sortWithinPartitions(h, *own).mapInArrow(run, schema)


def _log_cell(v: Column) -> Column:
    """A coarse cell number that never falls as the value rises."""
    size = lambda x: F.floor(F.log2(x) * LOG_STEPS) + F.lit(10_000)
    return (
        F.when(v == 0, F.lit(0)).when(v > 0, F.least(size(v), F.lit(30_000))).otherwise(-F.least(size(-v), F.lit(30_000)))
    ).cast("int")


def _pick(cells: DataFrame, group: list[str], cell: str) -> DataFrame:
    """From counted cells with ``below`` and ``target``, the one cell per group that holds the target rank."""
    w = Window.partitionBy(*group).orderBy(cell)
    return (
        cells.withColumn("__upto", F.sum("n").over(w))
        .where((F.col("below") + F.col("__upto") >= F.col("target")) & (F.col("below") + F.col("__upto") - F.col("n") < F.col("target")))
        .withColumn("below", F.col("below") + F.col("__upto") - F.col("n"))
        .drop("__upto")
    )


def _of_hot_groups(rows: DataFrame, own: list[str], qs: list[float]) -> DataFrame:
    """The same for groups of any size, by counting passes over the cluster."""
    rows = cut(Summary(rows, own).compact().frame.drop("again"))
    cells = rows.withColumn("cell", _log_cell(F.col("v"))).groupBy(*own, "cell").agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    upto = Window.partitionBy(*own).orderBy("cell")
    state = cut(
        cells.withColumn("n_readings", F.sum("n").over(Window.partitionBy(*own)))
        .withColumn("__upto", F.sum("n").over(upto))
        .withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
        .withColumn("target", F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n_readings") - F.lit(1e-9))))
        .where((F.col("__upto") >= F.col("target")) & (F.col("__upto") - F.col("n") < F.col("target")))
        .select(*own, "q", "n_readings", "target", (F.col("__upto") - F.col("n")).alias("below"), "lo", "hi")
    )
    done: list[DataFrame] = []
    live = rows
    while True:
        settled = F.col("lo") == F.col("hi")
        done.append(state.where(settled).select(*own, "q", "n_readings", F.col("lo").alias("value")))
        n_open = state.where(~settled).count()
        if n_open == 0:
            break
        of = [*own, "q"] if "q" in live.columns else own
        side = state.where(~settled).select(*[F.col(k).alias(f"__{k}") for k in of], *[c for c in ("q", "n_readings", "target", "below", "lo", "hi") if c not in of])
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in of])
        inside = (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
        before, live = live, cut(live.join(broadcast_if_small(side, n_open), on & inside).drop(*[f"__{k}" for k in of]))
        # both borders are of one sign and near each other since the first pass, so the width neither overflows nor vanishes;
        # they are values of their own, in the first and the last cell, so each pass drops one at least
        part = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
        cell = F.least(F.floor(part * (1 << BITS)), F.lit((1 << BITS) - 1)).cast("int")
        group = [*own, "q", "n_readings", "target", "below"]
        counted = live.withColumn("cell", cell).groupBy(*group, "cell").agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        state = cut(_pick(counted, group, "cell").select(*own, "q", "n_readings", "target", "below", "lo", "hi"))
        live = live.select(*own, "q", "v", "n")
        discard(before)
    return reduce(DataFrame.unionByName, done)


def percentiles(summary: Summary, qs: list[float], at_least: int = 1, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """(keys, q, n_readings, value): the reading at rank ceil(q*n) of each group of ``at_least`` readings, exactly.

    A group key of one of these names gets an underscore.
    """
    own = summary.own
    rows = summary.frame.withColumn("__h", F.xxhash64(*own))
    hot = cut(rows.groupBy("__h").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > heavy_rows).select("__h"))
    n_hot = hot.count()  # at most rows / heavy_rows
    cold = rows.join(broadcast_if_small(hot, n_hot), "__h", "left_anti") if n_hot else rows
    found = _of_groups(cold.drop("__h"), own, qs, at_least)
    if n_hot:
        large = _of_hot_groups(rows.join(broadcast_if_small(hot, n_hot), "__h", "left_semi").drop("__h"), own, qs)
        found = found.unionByName(large.where(F.col("n_readings") >= at_least))
    names = carried(summary.keys, ["q", "n_readings", "value"])
    return found.withColumnsRenamed(dict(zip(own, names, strict=True)))
