"""Implausible readings of sources too large for one task: judged as a whole, in blocks of time.

The rows of all such sources are cut into blocks of about equal size by ranges of (source, time, id), so a block
holds neighbouring readings of a source, and no task more than one block.  What a source's judgement needs is put together from
what its blocks tell, each a bounded summary:

1. sizes of innovations, which add up; the last reading of a block is handed to the next one, so that the innovation between them counts;
2. still runs, those at the borders of blocks joined, and steps of each kind; distinct values with their counts are added up
   over the cluster.  From these follow stuck runs, levels and noises, as for any other source;
3. the filters of each kind: each block goes on from the state that the last :data:`WARM` readings before it lead to.  A filter's
   state forgets what came before at the rate of its gain, so this is the state of one pass through all readings but for a part of
   about exp(-WARM * gain), e**-6 for a kind at rest.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracewright.functions.lanes import MAX_VALID_DUR
from tracewright.operators.spikes import (
    FAR_OFF, IMPOSSIBLE, MIN_RUN, REACH, REASONS, START, STUCK, VANISH, Filter, Near, Normal, Steps, by_code, impossible, innovations, merged, own_deviation, quiet, sizes_of, vanished,
)
from tracewright.plans.durable import broadcast_if_small, cut, cut_counted

#: Readings of a kind before a block that lead its filter into the block.
WARM = 200


class Run:
    """A chain of neighbouring readings with hardly an innovation: its ends, its values, and the sum of their squares.

    ``joined`` chains go on from the block before, ``open`` ones reach the end of their block.
    """

    __slots__ = ("first", "joined", "last", "n", "open", "squares", "start", "tally")

    def __init__(self, start: int, first: tuple, joined: bool = False) -> None:
        self.start, self.first, self.last, self.joined, self.open = start, first, first, joined, False
        self.n, self.squares, self.tally = 0, 0.0, Counter()


class Still:
    """The still runs of a block at one bound."""

    def __init__(self, bound: float) -> None:
        self.bound, self.near, self.at = bound, 0, 0
        self.runs: list[Run] = []
        self.open: Run | None = None

    def add(self, e: np.ndarray, pairs: list[tuple], ends: list[tuple]) -> None:
        with np.errstate(invalid="ignore"):
            still = np.abs(e) <= self.bound
        self.near += int(still.sum())
        squares = np.concatenate([[0.0], np.cumsum(np.where(still, e * e, 0.0))])

        def grow(a: int, b: int) -> None:
            run = self.open
            run.n += b - a
            # the first of a run has no innovation in it, unless that joins it to the block before
            run.squares += squares[b] - squares[a + (run.n == b - a and not run.joined)]
            run.last = ends[b - 1]
            run.tally.update(pairs[a:b])

        heads = np.flatnonzero(~still)
        until = int(heads[0]) if len(heads) else len(e)
        if until:
            if self.open is None:
                self.open = Run(self.at, ends[0], joined=True)
            grow(0, until)
        if len(heads):
            self._close()
            tails = np.append(heads[1:], len(e))
            wanted = (tails - heads >= MIN_RUN) | (tails == len(e))
            for a, b in zip(heads[wanted].tolist(), tails[wanted].tolist(), strict=True):
                self.open = Run(self.at + a, ends[a])
                grow(a, b)
                if b < len(e):
                    self._close()
        self.at += len(e)

    def _close(self) -> None:
        if self.open is not None and (self.open.n >= MIN_RUN or self.open.joined):
            self.runs.append(self.open)
        self.open = None

    def finished(self) -> list[Run]:
        if self.open is not None:
            self.open.open = True
            self.runs.append(self.open)
            self.open = None
        return self.runs


class Part:
    """What a block tells of its source: still runs, steps and last readings of each kind."""

    def __init__(self, own: float, prev: float) -> None:
        self.own, self.prev, self.n = own, prev, 0
        self.still = [Still(REACH * part * own) for part in VANISH]
        self.steps: dict[str, Steps] = {}
        self.tails: dict[str, list[tuple]] = {}

    def add(self, dur: np.ndarray, kind: list, time: np.ndarray, items: list, timed: np.ndarray) -> None:
        rows = np.flatnonzero(timed & ~impossible(dur))
        if not len(rows):
            return
        x = dur[rows]
        pairs = [(kind[i], v) for i, v in zip(rows.tolist(), x.tolist(), strict=True)]
        e = innovations(x, self.prev)
        ends = [(time[i], items[i]) for i in rows.tolist()]
        for s in self.still:
            s.add(e, pairs, ends)
        self.prev, self.n = float(x[-1]), self.n + len(x)
        moved: dict[str, list[float]] = {}
        for i in np.flatnonzero(~quiet(e, self.own)).tolist():
            moved.setdefault(pairs[i][0], []).append(pairs[i][1])
        for k, v in moved.items():
            self.steps.setdefault(k, Steps()).add(np.log(np.array(v)))
        last: dict[str, list[tuple]] = {}
        for (k, v), (t, i) in zip(pairs, ends, strict=True):
            last.setdefault(k, []).append((t, i, v))
        for k, rows_of in last.items():
            self.tails[k] = (self.tails.get(k, []) + rows_of)[-WARM:]

    def told(self) -> tuple:
        return self.own, self.n, [(s.near, s.finished()) for s in self.still], self.steps, self.tails


def chained(parts: list[tuple], level: int) -> tuple[list[Run], int]:
    """The runs of a whole source from those of its blocks in order, and how many innovations are within the bound."""
    out: list[Run] = []
    carry: Run | None = None
    at = near = 0
    for _, n, levels, _, _ in parts:
        near += levels[level][0]
        for r in levels[level][1]:
            r.start += at
            goes_on = r.open
            if r.joined and carry is not None:
                carry.n, carry.squares, carry.last = carry.n + r.n, carry.squares + r.squares, r.last
                carry.tally.update(r.tally)
                r, carry = carry, None
            elif carry is not None:
                out.append(carry)
                carry = None
            if goes_on:
                carry = r
            else:
                out.append(r)
        at += n
    if carry is not None:
        out.append(carry)
    return [r for r in out if r.n >= MIN_RUN], near


def judged(parts: list[tuple], kinds: list[str | None], code: np.ndarray, value: np.ndarray, timed: np.ndarray, other: np.ndarray) -> tuple[list[Run], dict, Normal]:
    """The stuck runs, codes of the kinds, and the normal behaviour of the rest.

    ``value`` of kind ``kinds[code]`` occurs ``timed`` times with a time and ``other`` times without.
    """
    own, n_all = parts[0][0], sum(p[1] for p in parts)
    values, place = np.unique(value[timed > 0], return_inverse=True)
    counts = np.bincount(place, timed[timed > 0], len(values)).astype(np.int64)
    stuck_runs: list[Run] = []
    for level, part in enumerate(VANISH):
        found, near = chained(parts, level)
        if not found or n_all < 2 * MIN_RUN:
            continue
        runs = []
        for run in found:
            tally: Counter = Counter()
            for (_, v), c in run.tally.items():
                tally[v] += c
            mine = np.array(sorted(tally), float)
            runs.append((run.start, run.n, run.squares, mine, np.array([tally[v] for v in mine.tolist()], np.int64)))
        hits = vanished(Near(values, counts, REACH * part * own), runs, n_all, near, part * own)
        places = merged([(r.start, r.n) for r in stuck_runs], [(r.start, r.n) for r, hit in zip(found, hits, strict=True) if hit])
        by_place = {(r.start, r.n): r for r in (*found, *stuck_runs)}
        stuck_runs = [by_place[x] for x in places]
    gone: Counter = Counter()
    for run in stuck_runs:
        gone.update(run.tally)
    left = timed + other
    if gone:
        for i in np.flatnonzero(np.isin(value, np.array([v for _, v in gone]))).tolist():
            left[i] -= gone[kinds[code[i]], float(value[i])]
    use = left > 0
    names = sorted({kinds[c] for c in np.unique(code[use]).tolist()} - {None})
    codes = {None: -1} | {k: i for i, k in enumerate(names)}
    recode = np.array([codes.get(k, -1) for k in kinds], np.int64)
    steps: dict[int, Steps] = {}
    for *_, of_block, _ in parts:
        for k, s in of_block.items():
            if k not in codes:
                continue
            had = steps.get(codes[k])
            if had is None:
                steps[codes[k]] = s
            else:
                had.sizes += s.sizes + sizes_of(np.array([s.first[0] - had.last]))
                had.first = (had.first + s.first)[:START]
                had.last = s.last
    normal = Normal(value[use], recode[code[use]], left[use], lambda k: steps[k].told() if k in steps else (0.0, 0.0))
    return stuck_runs, codes, normal


def _pieces(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[bool, tuple, pa.RecordBatch]]:
    """Stretches of equal keys in sorted batches, with whether the keys are new and the keys."""
    last = None
    for batch in batches:
        rows = list(zip(*[batch[c].to_pylist() for c in keys], strict=True))
        starts = [i for i, k in enumerate(rows) if i == 0 or k != rows[i - 1]]
        for a, b in zip(starts, [*starts[1:], len(rows)], strict=True):
            yield rows[a] != last, rows[a], batch.slice(a, b - a)
            last = rows[a]


def _inside(runs: list[tuple[tuple, tuple]], time: np.ndarray, items: list) -> np.ndarray:
    """Readings, in order of time, between the ends of a run."""
    out = np.zeros(len(time), bool)
    for (t0, i0), (t1, i1) in runs:
        a, b = np.searchsorted(time, t0, "left"), np.searchsorted(time, t1, "right")
        while a < b and time[a] == t0 and items[a] < i0:
            a += 1
        while b > a and time[b - 1] == t1 and items[b - 1] > i1:
            b -= 1
        out[a:b] = True
    return out


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list, np.ndarray]:
    time = np.array(batch["time"].cast(pa.float64()).to_numpy(zero_copy_only=False), float)
    time[np.isnan(time)] = np.inf
    return batch["value"].to_numpy(zero_copy_only=False), time, batch["item"].to_pylist(), batch["time"].is_valid().to_numpy(zero_copy_only=False)


def in_blocks(rows: DataFrame, own: list[str], out: T.StructType, n_blocks: int) -> DataFrame:
    """The implausible readings of large sources (own..., item, time, value, kind), cut into ``n_blocks``."""
    ordered = [F.col("time").asc_nulls_last(), F.col("item")]
    first = F.min(F.struct("time", "value", "kind")).alias("r")  # repeated rows once
    rows = rows.groupBy(*own, "item").agg(first).select(*own, "item", "r.*")
    rows = cut(rows.repartitionByRange(max(1, n_blocks), *own, *ordered).withColumn("block", F.spark_partition_id()))
    keys = [*own, "block"]
    key_fields = [rows.schema[k] for k in keys]
    binary = lambda name: T.StructField(name, T.BinaryType())
    number = lambda name: T.StructField(name, T.DoubleType())
    part_schema, plan_schema = T.StructType([*key_fields, binary("part")]), T.StructType([*key_fields, binary("plan")])
    size_schema = T.StructType([*key_fields, T.StructField("sizes", T.ArrayType(T.LongType())), number("first"), number("last")])
    border_schema = T.StructType([*key_fields, number("prev"), number("own")])
    size_arrow, part_arrow, plan_arrow, arrow = map(to_arrow_schema, (size_schema, part_schema, plan_schema, out))

    def row(schema: pa.Schema, *cells) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, schema, strict=True)], schema=schema)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, ends = None, None, [np.nan, np.nan]
        for fresh, new, piece in _pieces(batches, keys):
            if fresh:
                if key is not None:
                    yield row(size_arrow, *key, total.tolist(), *ends)
                key, total, ends = new, sizes_of(np.empty(0)), [np.nan, np.nan]
            dur, _, _, timed = _columns(piece)
            x = dur[timed & ~impossible(dur)]
            if len(x):
                total += sizes_of(innovations(x, ends[1]))
                ends = [float(x[0]) if np.isnan(ends[0]) else ends[0], float(x[-1])]
        if key is not None:
            yield row(size_arrow, *key, total.tolist(), *ends)

    def borders(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block").reset_index(drop=True)
        total, prev, before = np.sum(np.stack(pdf["sizes"].to_list()), axis=0), np.nan, []
        for a, b in zip(pdf["first"].tolist(), pdf["last"].tolist(), strict=True):
            before.append(prev)
            if not np.isnan(a):
                total = total + sizes_of(innovations(np.array([a]), prev))
                prev = b
        return pdf[keys].assign(prev=before, own=own_deviation(total))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part = None, None
        for fresh, new, piece in _pieces(batches, keys):
            if fresh:
                if key is not None:
                    yield row(part_arrow, *key, pickle.dumps(part.told()))
                prev = piece["prev"][0].as_py()
                key, part = new, Part(piece["own"][0].as_py(), np.nan if prev is None else prev)
            dur, time, items, timed = _columns(piece)
            part.add(dur, piece["kind"].to_pylist(), time, items, timed)
        if key is not None:
            yield row(part_arrow, *key, pickle.dumps(part.told()))

    def plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settled(key: tuple) -> Iterator[pa.RecordBatch]:
            arrays = [np.concatenate(c) if c else np.empty(0) for c in columns]
            runs, codes, normal = judged([p for _, p in told], list(of_kind), arrays[0].astype(np.int64), arrays[1], arrays[2].astype(np.int64), arrays[3].astype(np.int64))
            ends = [(r.first, r.last) for r in runs]
            warm: dict[int, list[tuple]] = {}
            for block, part in told:
                lead = {k: np.array([v for _, _, v in x])[~_inside(ends, np.array([t for t, _, _ in x]), [i for _, i, _ in x])] for k, x in warm.items()}
                yield row(plan_arrow, *key, block, pickle.dumps((ends, codes, normal, lead)))
                for k, x in part[4].items():
                    if k in codes:
                        warm[codes[k]] = (warm.get(codes[k], []) + x)[-WARM:]

        key, told, of_kind = None, [], {}
        columns: tuple[list, ...] = ([], [], [], [])
        for fresh, new, piece in _pieces(batches, own):
            if fresh:
                if key is not None:
                    yield from settled(key)
                key, told, of_kind, columns = new, [], {}, ([], [], [], [])
            known = piece["part"].is_valid().to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(known).tolist():
                told.append((piece["block"][i].as_py(), pickle.loads(piece["part"][i].as_py())))
            rest = piece.filter(pa.array(~known))
            if rest.num_rows:
                kinds = rest["kind"].dictionary_encode(null_encoding="encode")
                code = np.array([of_kind.setdefault(k, len(of_kind)) for k in kinds.dictionary.to_pylist()], np.int64)
                columns[0].append(code[kinds.indices.to_numpy()])
                for c, name in zip(columns[1:], ("value", "timed", "other"), strict=True):
                    c.append(rest[name].to_numpy(zero_copy_only=False))
        if key is not None:
            yield from settled(key)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: dict[int, Filter] = {}
        for fresh, _, piece in _pieces(batches, keys):
            if fresh:
                ends, codes, normal, lead = pickle.loads(piece["plan"][0].as_py())
                filters = {}
                piece = piece.slice(1)
            dur, time, items, timed = _columns(piece)
            bad, n = impossible(dur), int(timed.sum())  # untimed readings come last
            held = np.zeros(len(dur), bool)
            held[:n] = ~bad[:n] & _inside(ends, time[:n], items[:n])
            why = np.where(bad, IMPOSSIBLE, np.where(held, STUCK, 0))
            at = np.flatnonzero(why == 0)
            if normal.seen:
                names = piece["kind"].to_pylist()
                for k, of in by_code(np.array([codes[names[i]] for i in at.tolist()], np.int64)):
                    f = filters.get(k)
                    if f is None:
                        f = filters[k] = normal.filter(k)
                        if k in lead:
                            f.flags(np.log(lead[k]))
                    why[at[of[f.flags(np.log(dur[at[of]]))]]] = FAR_OFF
            hit = np.flatnonzero(why)
            yield pa.RecordBatch.from_arrays([piece["item"].take(pa.array(hit)), pa.array([REASONS[w] for w in why[hit].tolist()], pa.string())], schema=arrow)

    def sorted_by(df: DataFrame, by: list[str], *then) -> DataFrame:
        return df.repartition(*by).sortWithinPartitions(*by, *then)

    told = cut(sorted_by(rows, keys, *ordered).mapInArrow(sizes, size_schema))
    known, n_known = cut_counted(told.groupBy(*own).applyInPandas(borders, border_schema))
    summaries = sorted_by(rows.join(broadcast_if_small(known, n_known), keys), keys, *ordered).mapInArrow(parts, part_schema)
    plausible = F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") > 0) & (F.col("value") <= MAX_VALID_DUR)
    count = lambda of: F.sum(of.cast("long"))
    values = rows.where(plausible).groupBy(*own, "kind", "value").agg(count(F.col("time").isNotNull()).alias("timed"), count(F.col("time").isNull()).alias("other"))
    null = lambda name, kind: F.lit(None).cast(kind).alias(name)
    both = summaries.select(*keys, "part", null("kind", "string"), null("value", "double"), null("timed", "long"), null("other", "long")).unionByName(
        values.select(*own, null("block", "int"), null("part", "binary"), "kind", "value", "timed", "other")
    )
    planned = cut(sorted_by(both, own, F.col("block").asc_nulls_last()).mapInArrow(plans, plan_schema))
    bare = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("item", "time", "value", "kind")]
    all_rows = rows.select(*keys, "item", "time", "value", "kind", null("plan", "binary")).unionByName(planned.select(*keys, *bare, "plan"))
    return sorted_by(all_rows, keys, F.col("plan").isNull(), *ordered).mapInArrow(settle, out)
