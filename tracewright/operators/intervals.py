"""Continuous periods and gaps of overlapping integer intervals, by dyadic blocks.

Each half-open interval is cut at the borders of a fixed dyadic grid
(*cells* of ``2**cell_bits`` units), so a hot entity spreads over as many
groups as it has busy cells.  Inside a cell an interval becomes its canonical
dyadic blocks (aligned, of a power-of-two length); blocks covered by an
ancestor are removed, sibling pairs are merged upward, and adjacent blocks are
coalesced into runs.  The same kernel runs twice: over each incoming batch,
as a combiner before the shuffle, and over whole cells after it.

Of a long interval only the two ragged ends go to cells.  The cells between are blocks of a coarser level: they are handled
the same way in units of cells within *super-cells* (``2**super_bits`` cells), again with two ragged ends, and
the super-cells between in units of super-cells.  So an interval makes five pieces at most, however long it is.  Cells
and super-cells that a coarser block covers are removed.

Runs inside a cell are final.  Only the first and last run of a cell can
touch another cell; these edges are stitched in two further steps, within
super-cells and then per entity, so no step holds more than a bounded number
of edges of one entity.

Defined cases: an interval with a null border or ``end <= start`` is no
interval; a null key is an entity of its own; touching intervals (end = next
start) belong to one period; repeated rows change nothing; an empty input gives
an empty result; columns other than keys, start and end are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracewright.plans.durable import cut, observed

#: log2 of the cell length; with nanoseconds about 17 s, more than the longest valid reading takes.
CELL_BITS = 34
#: log2 of the cells in a super-cell.
SUPER_BITS = 12


def dyadic_blocks(base: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical blocks of [start, end): (base + block start, level), unordered."""
    out_s, out_k = [], []
    k = 0
    while len(start):
        size = np.int64(1) << k
        odd = (start >> k) & 1 == 1
        out_s.append((base + start)[odd])
        start = np.where(odd, start + size, start)
        odd_end = ((end >> k) & 1 == 1) & (start < end)
        out_s.append((base + end - size)[odd_end])
        out_k += [np.full(int(odd.sum()) + int(odd_end.sum()), k, np.int8)]
        end = np.where(odd_end, end - size, end)
        left = start < end
        base, start, end = base[left], start[left], end[left]
        k += 1
    if not out_s:
        return np.empty(0, np.int64), np.empty(0, np.int8)
    return np.concatenate(out_s), np.concatenate(out_k)


def drop_covered(start: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks in order of start without those that lie in an ancestor (or repeat)."""
    order = np.lexsort((-level, start))
    start, level = start[order], level[order]
    reach = np.maximum.accumulate(start + (np.int64(1) << level.astype(np.int64)))
    keep = np.ones(len(start), bool)
    keep[1:] = start[1:] >= reach[:-1]  # dyadic blocks nest or are disjoint
    return start[keep], level[keep]


def merge_siblings(start: np.ndarray, level: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Replace both halves of a block by the block, from the smallest level upward."""
    level = level.copy()
    alive = np.ones(len(start), bool)
    by_level = np.argsort(level, kind="stable")
    cuts = np.searchsorted(level[by_level], np.arange(top + 2))
    raised = np.empty(0, np.int64)
    for k in range(top):
        here = by_level[cuts[k] : cuts[k + 1]]
        if len(raised):
            here = np.sort(np.concatenate([here, raised]))
        if len(here) < 2:
            raised = np.empty(0, np.int64)
            continue
        s = start[here]
        pair = (s[1:] - s[:-1] == np.int64(1) << k) & ((s[:-1] >> k) & 1 == 0)
        raised = here[:-1][pair]
        alive[here[1:][pair]] = False
        level[raised] = k + 1
    return start[alive], level[alive]


def runs_of(base: np.ndarray, start: np.ndarray, end: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Coalesced runs of intervals given relative to ``base``, a multiple of ``2**(bits+1)`` each.

    The odd half of each base's range stays empty, so runs of different bases never touch.
    """
    s, k = dyadic_blocks(base, start, end)
    s, k = drop_covered(s, k)
    s, k = merge_siblings(s, k, bits)
    if not len(s):
        return s, s
    e = s + (np.int64(1) << k.astype(np.int64))
    fresh = np.ones(len(s), bool)
    fresh[1:] = s[1:] != e[:-1]
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(s) - 1)
    return s[fresh], e[last]


def _coalesce(groups: np.ndarray, start: np.ndarray, end: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs per group; ``groups`` are small whole numbers, borders lie in one cell of ``2**bits``."""
    shift = np.int64(bits + 1)
    s, e = runs_of(groups.astype(np.int64) << shift, start, end, bits)
    g = s >> shift
    return g, s - (g << shift), e - (g << shift)


def _codes(keys: pd.DataFrame) -> np.ndarray:
    return keys.groupby(list(keys.columns), sort=False, dropna=False).ngroup().to_numpy()


def _combiner(keys: list[str], bits: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [*keys, "__cell"]
            head = batch.select(cols).to_pandas()
            code = _codes(head)
            cell = head["__cell"].to_numpy() << bits
            g, s, e = _coalesce(code, batch["__start"].to_numpy() - cell, batch["__end"].to_numpy() - cell, bits)
            _, first = np.unique(code, return_index=True)
            rows = first[g]
            taken = batch.select(cols).take(pa.array(rows))
            arrays = [taken[c] for c in cols] + [pa.array(s + cell[rows]), pa.array(e + cell[rows])]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def _by_cell(keys: list[str], bits: int, schema: pa.Schema):
    """Runs and gaps of whole cells, from rows sorted by keys, cell and start."""
    cols = [*keys, "__cell"]

    def settle(table: pa.Table) -> pa.RecordBatch:
        head = table.select(cols).to_pandas()
        change = np.zeros(len(head), bool)
        for c in cols:
            x = head[c]
            same = (x == x.shift()) | (x.isna() & x.shift().isna())
            change |= ~same.to_numpy(bool)
        change[0] = True
        code = np.cumsum(change) - 1
        cell = head["__cell"].to_numpy() << bits
        g, s, e = _coalesce(code, table["__start"].to_numpy() - cell, table["__end"].to_numpy() - cell, bits)
        rows = np.flatnonzero(change)[g]
        s, e = s + cell[rows], e + cell[rows]
        first = np.ones(len(g), bool)
        first[1:] = g[1:] != g[:-1]
        last = np.append(first[1:], True)
        inner = ~first  # a gap lies before each run but the first
        prev_end = np.append(0, e[:-1])
        kind = np.where(first | last, "edge", "busy")
        all_rows = np.concatenate([rows, rows[inner]])
        taken = table.select(cols).take(pa.array(all_rows))
        arrays = [taken[c].combine_chunks() for c in cols] + [
            pa.array(np.concatenate([kind, np.full(int(inner.sum()), "gap")]).astype(object), pa.string()),
            pa.array(np.concatenate([s, prev_end[inner]])),
            pa.array(np.concatenate([e, s[inner]])),
            pa.array(np.concatenate([inner, np.zeros(int(inner.sum()), bool)])),
        ]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def compact(table: pa.Table) -> pa.Table:
        """Replace a table of one cell by its runs."""
        cell = np.int64(table["__cell"][0].as_py()) << bits
        _, s, e = _coalesce(np.zeros(table.num_rows, np.int64), table["__start"].to_numpy() - cell, table["__end"].to_numpy() - cell, bits)
        one = table.select(cols).take(pa.array(np.zeros(len(s), np.int64)))
        return pa.Table.from_arrays([*one.columns, pa.array(s + cell), pa.array(e + cell)], schema=table.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            tail = {c: table[c][table.num_rows - 1].as_py() for c in cols}
            same = np.ones(table.num_rows, bool)
            for c in cols:
                x = table[c].to_pandas()
                same &= (x.isna() if tail[c] is None else (x == tail[c])).to_numpy(bool)
            at = int(np.flatnonzero(same)[0])
            if at:
                yield settle(table.slice(0, at))
            held = compact(table.slice(at))
        if held is not None:
            yield settle(held)

    return run


def _stitch(edges: DataFrame, part: list[str], final: bool) -> DataFrame:
    """Join edge runs that touch, within ``part``; rows of kind busy, gap and (unless final) edge."""
    w = Window.partitionBy(*part).orderBy("__start")
    x = edges.withColumn("__prev", F.lag("__end").over(w))
    x = x.withColumn("__new", F.col("__prev").isNull() | F.col("__hole") | (F.col("__start") > F.col("__prev")))
    x = x.withColumn("__gap", F.col("__prev").isNotNull() & ~F.col("__hole") & (F.col("__start") > F.col("__prev")))
    x = x.withColumn("__island", F.sum(F.col("__new").cast("long")).over(w))
    islands = x.groupBy(*part, "__island").agg(
        F.min("__start").alias("__start"), F.max("__end").alias("__end"),
        F.max(F.when(F.col("__gap"), F.col("__prev"))).alias("__gap_from"),
    )
    if final:
        islands = islands.withColumn("kind", F.lit("busy")).withColumn("__hole", F.lit(False))
    else:
        top = F.max("__island").over(Window.partitionBy(*part))
        islands = islands.withColumn("kind", F.when((F.col("__island") == 1) | (F.col("__island") == top), "edge").otherwise("busy"))
        islands = islands.withColumn("__hole", F.col("__island") > 1)
    # one row per island and one per gap before it
    rows = F.array(
        F.struct(F.col("kind"), F.col("__start"), F.col("__end"), F.col("__hole")),
        F.struct(F.lit("gap").alias("kind"), F.col("__gap_from").alias("__start"), F.col("__start").alias("__end"), F.lit(False).alias("__hole")),
    )
    return (
        islands.select(*part, F.explode(rows).alias("__row"))
        .select(*part, "__row.*")
        .where(F.col("__start").isNotNull())
    )


def _ends(x: DataFrame, own: list[str], a: str, b: str, bits: int) -> DataFrame:
    """(own..., __cell, __start, __end): the parts of intervals in their first and their last cell."""
    x = x.withColumn("__cell", F.explode(F.array_distinct(F.array("__first", "__last"))))
    return x.select(
        *own, "__cell",
        F.greatest(F.col(a), F.shiftleft("__cell", bits)).alias("__start"),
        # the last cell of all ends where whole numbers do
        F.when(F.col("__cell") == F.col("__last"), F.col(b)).otherwise(F.shiftleft(F.col("__cell") + 1, bits)).alias("__end"),
    )


def _in_cells(pieces: DataFrame, own: list[str], bits: int) -> DataFrame:
    """Runs and gaps of each cell, the first and the last run as edges."""
    piece = to_arrow_schema(pieces.schema)
    x = pieces.mapInArrow(_combiner(own, bits, piece), pieces.schema)
    x = x.repartition(*own, "__cell").sortWithinPartitions(*own, "__cell", "__start")
    out = T.StructType(
        [*x.schema.fields[: len(own) + 1], T.StructField("kind", T.StringType()), T.StructField("__start", T.LongType()),
         T.StructField("__end", T.LongType()), T.StructField("__hole", T.BooleanType())]
    )
    return x.mapInArrow(_by_cell(own, bits, to_arrow_schema(out)), out)


def _islands(x: DataFrame, part: list[str]) -> DataFrame:
    """Blocks [__start, __end) of whole units within ``part``, overlapping and touching ones joined."""
    w = Window.partitionBy(*part).orderBy("__start")
    x = x.groupBy(*part, "__start").agg(F.max("__end").alias("__end"))
    reach = F.max("__end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("__k", F.coalesce((F.col("__start") > reach).cast("long"), F.lit(1)))
    x = x.withColumn("__k", F.sum("__k").over(w))
    return x.groupBy(*part, "__k").agg(F.min("__start").alias("__start"), F.max("__end").alias("__end")).drop("__k")


def _covered(units: DataFrame, unit: str, blocks: DataFrame, part: list[str]) -> DataFrame:
    """The distinct units that lie in a block of their ``part``."""
    points = units.distinct().select(*part, F.col(unit).alias("__at"), F.lit(None).cast("long").alias("__to"))
    both = points.unionByName(blocks.select(*part, F.col("__start").alias("__at"), F.col("__end").alias("__to")))
    w = Window.partitionBy(*part).orderBy("__at", F.col("__to").isNull())  # blocks before units
    reached = both.withColumn("__reach", F.max("__to").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return reached.where(F.col("__to").isNull() & (F.col("__reach") > F.col("__at"))).select(*part, F.col("__at").alias(unit))


def _without(x: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    other = gone.select(*[F.col(k).alias(f"{k}_") for k in keys])
    return x.join(other, reduce(lambda p, q: p & q, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]), "left_anti")


def _block_edges(blocks: DataFrame, bits: int) -> DataFrame:
    """Blocks as runs in units of the input."""
    return blocks.withColumns({"__start": F.shiftleft("__start", bits), "__end": F.shiftleft("__end", bits), "kind": F.lit("edge"), "__hole": F.lit(False)})


def merge_intervals(
    df: DataFrame, keys: list[str], start: str, end: str, *, cell_bits: int = CELL_BITS, super_bits: int = SUPER_BITS
) -> DataFrame:
    """(keys, kind, start, end): busy periods and the gaps between them, per entity."""
    own = [f"__k{i}" for i in range(len(keys))]
    a, b = F.col(start).cast("long"), F.col(end).cast("long")
    x = df.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], a.alias("__a"), b.alias("__b")).where(
        F.col("__a").isNotNull() & F.col("__b").isNotNull() & (F.col("__a") < F.col("__b"))
    )
    first, last = F.shiftright("__a", cell_bits), F.shiftright(F.col("__b") - 1, cell_bits)
    x = x.withColumns({"__first": first, "__last": last})
    seen = Observation()
    long = F.col("__last") - F.col("__first") > 1
    pieces = _ends(x.observe(seen, F.max(long).alias("long")), own, "__a", "__b", cell_bits)
    cells = cut(_in_cells(pieces, own, cell_bits))
    is_edge = F.col("kind") == "edge"
    upper = top = None
    if observed(seen).get("long"):
        inner = x.where(long).select(*own, (F.col("__first") + 1).alias("__a"), F.col("__last").alias("__b"))
        inner = cut(inner.groupBy(*own, "__a").agg(F.max("__b").alias("__b")))
        inner = inner.withColumns({"__first": F.shiftright("__a", super_bits), "__last": F.shiftright(F.col("__b") - 1, super_bits)})
        runs = _in_cells(_ends(inner, own, "__a", "__b", super_bits), own, super_bits).where("kind <> 'gap'")
        upper = cut(runs.select(*own, F.col("__cell").alias("__super"), "__start", "__end"))
        whole = inner.where(F.col("__last") - F.col("__first") > 1).select(*own, (F.col("__first") + 1).alias("__start"), F.col("__last").alias("__end"))
        top = cut(_islands(whole, own))
        supers = cells.select(*own, F.shiftright("__cell", super_bits).alias("__super")).unionByName(upper.select(*own, "__super"))
        under = cut(_covered(supers, "__super", top, own))
        upper = _without(upper, under, [*own, "__super"])
        cells = _without(cells.withColumn("__super", F.shiftright("__cell", super_bits)), under, [*own, "__super"])
        hidden = _covered(cells.select(*own, "__super", "__cell"), "__cell", upper, [*own, "__super"])
        cells = cut(_without(cells, cut(hidden), [*own, "__super", "__cell"]).drop("__super"))
    edges = cells.where(is_edge).withColumn("__super", F.shiftright("__cell", super_bits)).drop("__cell")
    if upper is not None:
        edges = edges.unionByName(_block_edges(upper, cell_bits))
    mid = _stitch(edges, [*own, "__super"], final=False)
    last_edges = mid.where(is_edge).drop("__super")
    if top is not None:
        last_edges = last_edges.unionByName(_block_edges(top, cell_bits + super_bits))
    parts = [cells.where(~is_edge), mid.where(~is_edge), _stitch(last_edges, own, final=True)]
    cols = [*own, "kind", "__start", "__end"]
    merged = reduce(DataFrame.unionByName, [p.select(*cols) for p in parts])
    return merged.select(*[F.col(o).alias(k) for k, o in zip(keys, own, strict=True)], "kind", F.col("__start").alias(start), F.col("__end").alias(end))
