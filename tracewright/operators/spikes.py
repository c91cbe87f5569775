"""Implausible readings per source: spikes, stuck values, impossible values.

A source is a lane; its readings are modelled on the log scale in order of
time.  Two forecasts are made of each reading:

* From its kind of work: a local-level Kalman filter per source and kind.  A standardised innovation beyond the
  threshold is flagged and its update withheld, so a spike does not move the level.  A kind with few readings has no noise
  of its own and is forecast from what the kinds of its source span (:class:`Band`).
* From the reading before, whatever its kind: a random walk, as the source's sensor is one.  Where the variance of these
  innovations vanishes against that of the source (:data:`VANISH`), for longer than the source's own variation allows, the
  sensor is stuck.

Readings no clock can deliver are impossible.

Normal are: a regular mix of kinds of work (each has a level of its own), a slow
mode that recurs in one kind (a second level, accepted when a fair part of
its readings gather closely around it), a coarse clock (the step is a floor of the noise) and a source that
is always constant (its runs are as long as its variation lets them be).  Levels to start from and noises are robust
estimates over the whole source; the filter follows the level from there.  Where a kind's level moves by far more than its
readings scatter (:data:`MOVES_PART`), the noise is that of the steps between readings, the filter starts from the first
readings, and after a jump for good the first :data:`SHIFT` readings are flagged, then they are the level.

A source with many rows is judged as a whole, like any other, but in blocks of time (``hot_sources.py``).

Defined cases: null readings are no case; NaN, infinite, non-positive values and those above
``MAX_VALID_DUR`` are impossible; readings without a time are compared with the levels but are in no run;
rows without a source are ignored; a null kind is compared with all levels of its source; equal
times follow the id; repeated rows of one id count once; a source with too few
readings shows impossible values only; an empty input gives an empty result;
columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracewright.functions.lanes import MAX_VALID_DUR
from tracewright.plans.durable import broadcast_if_small, cut

#: Standardised innovations beyond this are spikes.
THRESHOLD = 6.5
#: Least noise of a log reading.
FLOOR = 0.01
#: Chance, over a whole source, that a run as long arises by itself.
RUN_CHANCE = 1e-4
#: Shortest run that can be stuck.
MIN_RUN = 6
#: Deviations of innovations, as parts of the source's own, at which their variance has vanished: nearly nothing, and little.
VANISH = (0.0015, 0.03)
#: An innovation within a run is at most this many times the deviation at which variance has vanished.
REACH = 2.0
#: The clock's step; readings no further apart than one step are equal to it.
GRAIN = 0.125
#: Share of readings of one value from which a source counts as constant, and a kind of work does.
CONSTANT, CONSTANT_KIND = 0.5, 0.8
#: A factor of e is far off for any source, if it is beyond so many deviations.
FAR, FAR_THRESHOLD = 1.0, 5.0
#: Share and number of readings that make a second level a slow mode, and its largest spread.
SLOW_SHARE, SLOW_COUNT, SLOW_SPREAD = 0.06, 5, 0.30
#: Log distance by which a kind with hardly any readings may differ from the others of its source.
WIDE = 0.7
#: Process noise of the level, as a part of the reading noise.
DRIFT = 0.03
#: Readings from which a kind has a noise of its own.
OWN_NOISE = 8
#: A kind whose readings deviate by more than this from their median, but by less than this part of it from one to the next, has a moving level.
MOVES_WIDE, MOVES_PART = 0.2, 0.5
#: Readings from which a moving level starts, and after which withheld readings that agree are its new place.
START, SHIFT = 15, 8
#: Rows of a source from which it is judged in blocks of about so many.
BLOCK_ROWS = 50_000


def impossible(dur: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return ~((dur > 0) & (dur <= MAX_VALID_DUR))


def innovations(x: np.ndarray, before: float = np.nan) -> np.ndarray:
    """What each reading differs, on the log scale, from its forecast by a random walk, the reading before; NaN for a first one."""
    was = np.concatenate([[before], x[:-1]])
    e = np.log(x) - np.log(was)
    return np.where(np.abs(x - was) <= GRAIN * 1.001, 0.0, e)


#: Bins of the sizes of innovations: eight to a doubling, from 2**-30 to 2**34.
_BINS = 512


def sizes_of(e: np.ndarray) -> np.ndarray:
    """How many innovations are of which size; these counts add up over the parts of a source."""
    size = np.abs(e[~np.isnan(e)])
    with np.errstate(divide="ignore"):
        at = np.clip(np.floor(np.log2(size) * 8) + 240, 0, _BINS - 1)
    return np.bincount(at.astype(np.int64), minlength=_BINS)


def own_deviation(sizes: np.ndarray) -> float:
    """A robust standard deviation of the source's innovations, 0 where most of them are nothing."""
    upto = np.cumsum(sizes)
    if not upto[-1]:
        return 0.0
    at = int(np.searchsorted(upto, upto[-1] / 2))
    return 0.0 if at == 0 else float(1.4826 * 2 ** ((at - 240) / 8))


def quiet(e: np.ndarray, own: float | None = None) -> np.ndarray:
    """Readings with hardly an innovation, stuck or not, which tell nothing of a kind's own steps."""
    own = own_deviation(sizes_of(e)) if own is None else own
    with np.errstate(invalid="ignore"):
        return np.abs(e) <= REACH * max(VANISH) * own


class Near:
    """Distinct values of a source with their counts, and how many readings lie how near to each."""

    def __init__(self, values: np.ndarray, counts: np.ndarray, bound: float) -> None:
        self.values, self.counts, self.bound = values, counts, bound
        self.upto = np.concatenate([[0], np.cumsum(counts)])
        a, b = self._within(values, 1)
        self.near = self.upto[b] - self.upto[a]
        self.pairs = int((counts * self.near).sum())

    def _within(self, x: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
        reach = np.exp(times * self.bound)
        low, high = np.minimum(x / reach, x - times * GRAIN * 1.001), np.maximum(x * reach, x + times * GRAIN * 1.001)
        return np.searchsorted(self.values, low, "left"), np.searchsorted(self.values, high, "right")

    def without(self, values: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
        """Without these readings: the chance that two are near each other, and the share near the median of these."""
        n = int(self.upto[-1] - counts.sum())
        a, b = self._within(values, 1)
        own = np.concatenate([[0], np.cumsum(counts)])
        low, high = np.searchsorted(values, self.values[a], "left"), np.searchsorted(values, self.values[b - 1], "right")
        inner = int((counts * (own[high] - own[low])).sum())
        # near is mutual, so pairs with one of these count twice
        pairs = self.pairs - 2 * int((counts * self.near[np.searchsorted(self.values, values)]).sum()) + inner - n
        c, d = self._within(np.array([median(values, counts)]), 2)
        taken = own[np.searchsorted(values, self.values[d[0] - 1], "right")] - own[np.searchsorted(values, self.values[c[0]], "left")] if d[0] > c[0] else 0
        share = (self.upto[d[0]] - self.upto[c[0]] - taken) / n
        return max((pairs + 1) / (n * (n - 1) + 1), 1 / (n + 1)), float(share)


def vanished(near: Near, runs: list[tuple[int, int, float, np.ndarray, np.ndarray]], n_all: int, n_near: int, deviation: float) -> list[bool]:
    """Which runs (start, readings, sum of squared innovations, values, counts) hold still far longer than the source allows.

    ``n_near`` is how many innovations of the source are within the bound, ``deviation`` that at which variance has vanished.
    """
    touched, end = 0, -1
    for start, n, *_ in runs:  # their own pairs, the one to the left unless a run ended there, and the one to the right
        touched += n - 1 + (start > 0 and end != start) + (start + n < n_all)
        end = start + n
    free = n_all - 1 - touched
    by_itself = (n_near - sum(n - 1 for _, n, *_ in runs)) / free if free > 0 else 0.0
    out = []
    for _, n, squares, values, counts in runs:
        stuck_here = False
        if n_all - n >= MIN_RUN and squares / (n - 1) <= deviation**2:
            p, share = near.without(values, counts)
            p = max(p, by_itself)
            # where most others are as near, the source itself is constant
            stuck_here = share < CONSTANT and p < 1 and np.log(n_all) + (n - 1) * np.log(p) < np.log(RUN_CHANCE)
        out.append(bool(stuck_here))
    return out


def stuck(x: np.ndarray) -> np.ndarray:
    """Readings in runs in which the variance of the innovations has vanished."""
    out = np.zeros(len(x), bool)
    if len(x) < 2 * MIN_RUN:
        return out
    e = innovations(x)
    own = own_deviation(sizes_of(e))
    size = np.abs(e[1:])
    found: list[tuple[int, int]] = []
    for part in VANISH:
        still = size <= REACH * part * own
        edge = np.diff(np.concatenate([[0], still.astype(np.int8), [0]]))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        long = b - a >= MIN_RUN
        if not long.any():
            continue
        runs = []
        for i, j in zip(a[long].tolist(), b[long].tolist(), strict=True):
            runs.append((i, j - i, float((size[i : j - 1] ** 2).sum()), *np.unique(x[i:j], return_counts=True)))
        near = Near(*np.unique(x, return_counts=True), REACH * part * own)
        hits = vanished(near, runs, len(x), int(still.sum()), part * own)
        found = merged(found, [(i, n) for hit, (i, n, *_) in zip(hits, runs, strict=True) if hit])
    for i, n in found:
        out[i : i + n] = True
    return out


def merged(narrow: list[tuple[int, int]], wide: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stuck runs (start, readings) of a narrower and of a wider bound; each narrow one lies within one chain of the wider.

    A wide run of which narrow ones make up half or more is one of them with neighbours that are near by chance.
    """
    if not narrow or not wide:
        return narrow or wide
    begins = np.array([j for j, _ in narrow])
    upto = np.concatenate([[0], np.cumsum([n for _, n in narrow])])
    a, b = (np.searchsorted(begins, x, "left") for x in ([i for i, _ in wide], [i + m for i, m in wide]))
    inside = (upto[b] - upto[a]).tolist()
    kept = [w for w, n in zip(wide, inside, strict=True) if 2 * n < w[1]]
    at = (np.searchsorted([i for i, _ in kept], begins, "right") - 1).tolist()
    return sorted(kept + [r for r, k in zip(narrow, at, strict=True) if k < 0 or r[0] >= sum(kept[k])])


def median(x: np.ndarray, w: np.ndarray) -> float:
    """The median of values ``x`` that occur ``w`` times each."""
    order = np.argsort(x, kind="stable")
    upto = np.cumsum(w[order])
    n = int(upto[-1])
    low, high = (x[order[np.searchsorted(upto, k, "right")]] for k in ((n - 1) // 2, n // 2))
    return float(low) if low == high else float((low + high) / 2)


class Level:
    """Normal behaviour of one kind of work (values ``y`` that occur ``w`` times each): level, noise, and a slow mode if it has one."""

    __slots__ = ("level", "moves", "n", "noise", "reach", "slow", "slow_noise", "start")

    def __init__(self, y: np.ndarray, step: float, pooled: float, w: np.ndarray, steps: Callable[[], tuple[float, float]]) -> None:
        self.n = int(w.sum())
        self.level = median(y, w)
        dev = np.abs(y - self.level)
        own = 1.4826 * median(dev, w)
        if own < FLOOR:  # one value prevails: the others tell the noise, unless they are few
            other = dev > 1e-9
            if w[other].sum() > (1 - CONSTANT_KIND) * self.n:
                own = 1.4826 * median(dev[other], w[other])
        self.start, self.moves, wide = self.level, False, own
        if own > MOVES_WIDE and self.n >= 2 * START:
            scatter, first = steps()
            self.moves = 0 < scatter < MOVES_PART * own
            if self.moves:
                own, self.start = scatter, first
        if pooled >= 0 and not self.moves:  # few readings lean on the whole source
            lean = min(1.0, self.n / 40)
            own = max(own, 0.6 * pooled) if lean == 1.0 else max(lean * own + (1 - lean) * pooled, 0.6 * pooled)
        self.noise = max(own, step / np.exp(self.level), FLOOR)
        self.slow = self.slow_noise = None
        self.reach = self.threshold() * self.noise + (3 * wide if self.moves else 0.0)
        if self.moves:
            return
        far = y - self.level > 5 * self.noise
        n_far = w[far].sum()
        if n_far >= max(SLOW_COUNT, SLOW_SHARE * self.n):
            mid = median(y[far], w[far])
            near = far & (np.abs(y - mid) <= SLOW_SPREAD)
            if w[near].sum() >= max(SLOW_COUNT, 0.6 * n_far, 0.75 * SLOW_SHARE * self.n):
                self.slow, self.slow_noise = mid, max(self.noise, 1.4826 * median(np.abs(y[near] - mid), w[near]))

    def threshold(self) -> float:
        """Deviations allowed: more where few readings tell the noise, never more than a factor of e needs."""
        return max(FAR_THRESHOLD, min(THRESHOLD * (1 + 5 / max(self.n, 1)), FAR / self.noise))


class Band:
    """A forecast that readings do not move: those up to ``half`` from ``mid`` are expected."""

    __slots__ = ("half", "mid")

    def __init__(self, low: float, high: float) -> None:
        self.mid, self.half = (low + high) / 2, (high - low) / 2


class Filter:
    """The Kalman filter of one kind of work, with a second level and bands where it has them; its state goes on from call to call."""

    def __init__(self, level: float | None, noise: float, n: int, limit: float, slow: tuple[float, float] | None = None, bands: tuple[Band, ...] = (), moves: bool = False) -> None:
        self.away: list[float] | None = [] if moves else None  # withheld readings in a row
        self.r, self.q, self.limit = noise**2, (DRIFT * noise) ** 2, limit**2
        self.rs = slow[1] ** 2 if slow else self.r
        self.bands = [(b.mid, b.half**2 * (1 + 1e-12)) for b in bands]
        self.state = (level, self.r / max(1, min(n, 50)), slow[0] if slow else None, self.r)

    def flags(self, y: np.ndarray) -> np.ndarray:
        """Flagged readings in order of time; flagged updates are withheld."""
        r, q, limit, rs, bands, away = self.r, self.q, self.limit, self.rs, self.bands, self.away
        m, p, slow, ps = self.state
        flags = [False] * len(y)
        for i, v in enumerate(y.tolist()):
            if m is not None:
                p += q
                e = v - m
                s = p + r
                if e * e <= limit * s:
                    k = p / s
                    m += k * e
                    p -= k * p
                    if away:
                        away.clear()
                    continue
            if slow is not None:
                ps += q
                e = v - slow
                s = ps + rs
                if e * e <= limit * s:
                    k = ps / s
                    slow += k * e
                    ps -= k * ps
                    continue
            for mid, half in bands:
                if (v - mid) ** 2 <= half:
                    break
            else:
                flags[i] = True
                if away is not None:
                    away.append(v)
                    last = away[-SHIFT:]
                    if len(last) == SHIFT and (max(last) - min(last)) ** 2 <= limit * r:  # a new place
                        m, p = sorted(last)[SHIFT // 2], r
                        away.clear()
            if p > r:  # a level not seen for long stays bounded in doubt
                p = r
        self.state = (m, p, slow, ps)
        return np.array(flags, bool)


def clock_step(x: np.ndarray, w: np.ndarray) -> float:
    """The step of a coarse clock: the least distance of values that recur, if all of them are multiples of it."""
    values, place = np.unique(x, return_inverse=True)
    counts, n = np.bincount(place, w), w.sum()
    if len(values) > max(12, n / 4):
        return 0.0
    often = values[counts >= max(2, 0.02 * n)]
    if len(often) < 2:
        return 0.0
    step = float(np.diff(often).min())
    return step if (np.abs(often / step - np.round(often / step)) < 0.07).all() else 0.0


def by_code(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each code with its places, in order."""
    order = np.argsort(codes, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
        if len(at):
            yield int(codes[at[0]]), at


class Normal:
    """What a source normally shows, from its plausible values: ``dur`` of ``kind`` (a code or -1) occurs ``w`` times."""

    def __init__(self, dur: np.ndarray, kind: np.ndarray, w: np.ndarray, steps: Callable[[int], tuple[float, float]]) -> None:
        """``steps`` tells of a kind the scatter of its steps and where it starts."""
        self.seen = int(w.sum()) >= MIN_RUN
        self.lone, self.levels, self.few = None, {}, {}
        if not self.seen:
            return
        y, step = np.log(dur), clock_step(dur, w)
        of = {k: at for k, at in by_code(kind) if k >= 0}
        large = {k: at for k, at in of.items() if w[at].sum() >= OWN_NOISE}
        if not large:  # no kind has readings enough: the source is one kind
            self.lone = Level(y, step, -1.0, w, lambda: (0.0, 0.0))
            return
        resid = [np.abs(y[at] - median(y[at], w[at])) for at in large.values()]
        self.pooled = 1.4826 * median(np.concatenate(resid), np.concatenate([w[at] for at in large.values()]))
        self.levels = {k: Level(y[at], step, self.pooled, w[at], lambda k=k: steps(k)) for k, at in large.items()}
        self.low = min(lv.level - lv.reach for lv in self.levels.values())
        self.high = max(lv.level + lv.reach for lv in self.levels.values())
        self.few = {k: (int(w[at].sum()), median(y[at], w[at])) for k, at in of.items() if k not in large}

    def filter(self, k: int) -> Filter | None:
        """The filter of kind ``k`` at its start; none for a source with too few readings."""
        if not self.seen:
            return None
        lv = self.lone or self.levels.get(k)
        if lv is not None:
            slow = (lv.slow, lv.slow_noise) if lv.slow is not None else None
            bands = (Band(lv.level - FAR, lv.level + FAR),) if self.lone else ()
            return Filter(lv.start, lv.noise, 1 if lv.moves else lv.n, lv.threshold(), slow, bands, lv.moves)
        if k in self.few:
            n, mid = self.few[k]
            if n >= 3:
                return Filter(mid, max(self.pooled, FAR / THRESHOLD), n, THRESHOLD, None, (Band(self.low, self.high),))
            return Filter(None, self.pooled, n, THRESHOLD, None, (Band(self.low - WIDE, self.high + WIDE),))  # kinds of one source differ by so much
        slow = [Band(lv.slow - lv.threshold() * lv.slow_noise, lv.slow + lv.threshold() * lv.slow_noise) for lv in self.levels.values() if lv.slow is not None]
        return Filter(None, self.pooled, 1, THRESHOLD, None, (Band(self.low, self.high), *slow))


class Steps:
    """Of one kind: the sizes of its steps from reading to reading, and its first readings."""

    __slots__ = ("first", "last", "sizes")

    def __init__(self) -> None:
        self.sizes, self.first, self.last = np.zeros(_BINS, np.int64), [], np.nan

    def add(self, y: np.ndarray) -> None:
        if len(y):
            self.sizes += sizes_of(np.diff(y, prepend=self.last))
            self.first += y[: START - len(self.first)].tolist()
            self.last = float(y[-1])

    def told(self) -> tuple[float, float]:
        """Scatter about a level that hardly moves from reading to reading, and the level of the first readings."""
        return own_deviation(self.sizes) / np.sqrt(2), float(np.median(self.first)) if self.first else 0.0


IMPOSSIBLE, STUCK, FAR_OFF = 1, 2, 3
REASONS = {IMPOSSIBLE: "impossible", STUCK: "stuck", FAR_OFF: "far off"}


def judge(dur: np.ndarray, kind: np.ndarray, timed: np.ndarray) -> np.ndarray:
    """Reasons (0: none) for one source: readings in order of time (untimed last), ``kind`` a code or -1."""
    why = np.zeros(len(dur), np.int8)
    bad = impossible(dur)
    run = np.flatnonzero(~bad & timed)
    held = np.zeros(len(dur), bool)
    held[run] = stuck(dur[run])
    why[bad], why[held] = IMPOSSIBLE, STUCK
    use = np.flatnonzero(~bad & ~held)

    def steps(k: int) -> tuple[float, float]:
        x, found = dur[run], Steps()
        found.add(np.log(x[(kind[run] == k) & ~quiet(innovations(x))]))
        return found.told()

    normal = Normal(dur[use], kind[use], np.ones(len(use), np.int64), steps)
    if normal.seen:
        for k, at in by_code(kind[use]):
            why[use[at[normal.filter(k).flags(np.log(dur[use[at]]))]]] = FAR_OFF
    return why


def implausible(df: DataFrame, source: list[str], *, item: str, time: str, value: str, kind: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(item, reason): the readings that cannot be right for their source, with ``impossible``, ``stuck`` or ``far off``."""
    own = [f"s{i}" for i in range(len(source))]
    rows = df.select(
        *[F.col(c).alias(o) for c, o in zip(source, own, strict=True)],
        F.col(item).alias("item"), F.col(time).alias("time"), F.col(value).cast("double").alias("value"), F.col(kind).cast("string").alias("kind"),
    )
    for o in own:
        rows = rows.where(F.col(o).isNotNull())
    rows = rows.where(F.col("value").isNotNull() & F.col("item").isNotNull())
    keys = own
    reason = "reason" if item != "reason" else "reason_"
    out = T.StructType([T.StructField(item, rows.schema["item"].dataType), T.StructField(reason, T.StringType())])

    def settle(table: pa.Table) -> pa.RecordBatch:
        head = table.select(keys).to_pandas()
        change = np.zeros(len(head), bool)
        for c in keys:
            x = head[c]
            change |= ~((x == x.shift()) | (x.isna() & x.shift().isna())).to_numpy(bool)
        change[0] = True
        starts = np.flatnonzero(change)
        ends = np.append(starts[1:], len(head))
        ids = table["item"].combine_chunks()
        id_codes = ids.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        dur = table["value"].to_numpy()
        codes = table["kind"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(float)
        codes = np.where(np.isnan(codes), -1, codes).astype(int)
        timed = ~table["time"].is_null().to_numpy()
        why = np.zeros(len(head), np.int8)
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            at = np.arange(a, b)
            _, first = np.unique(id_codes[a:b], return_index=True)  # repeated rows once
            at = at[np.sort(first)]
            at = np.concatenate([at[timed[at]], at[~timed[at]]])
            why[at] = judge(dur[at], codes[at], timed[at])
        hit = np.flatnonzero(why)
        words = pa.array([REASONS[w] for w in why[hit].tolist()], pa.string())
        return pa.RecordBatch.from_arrays([ids.take(pa.array(hit)), words], names=[item, reason])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            tail = {c: batch[c][batch.num_rows - 1] for c in keys}
            same = np.ones(batch.num_rows, bool)
            for c in keys:
                x = batch[c].to_pandas()
                same &= (x.isna() if not tail[c].is_valid else (x == tail[c].as_py())).to_numpy(bool)
            at = int(np.flatnonzero(same)[0])
            grows = bool(held) and at == 0 and all(held[0][c][0] == tail[c] or (not held[0][c][0].is_valid and not tail[c].is_valid) for c in keys)
            if held and not grows:
                yield settle(pa.Table.from_batches([*held, batch.slice(0, at)]))
                held = []
            elif at:
                yield settle(pa.Table.from_batches([batch.slice(0, at)]))
            held.append(batch.slice(at))  # one source at most
        if held:
            yield settle(pa.Table.from_batches(held))

    hot = cut(rows.groupBy(*own).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > block_rows))
    n_hot, n_rows = hot.agg(F.count(F.lit(1)), F.sum("__n")).first()
    hot = hot.select(*own)
    small = rows.join(broadcast_if_small(hot, n_hot), own, "left_anti") if n_hot else rows
    found = small.repartition(*keys).sortWithinPartitions(*keys, "time", "item").mapInArrow(run, out)
    if not n_hot:
        return found
    from tracewright.operators.hot_sources import in_blocks

    return found.unionByName(in_blocks(rows.join(broadcast_if_small(hot, n_hot), own, "left_semi"), own, out, -(-n_rows // block_rows)))
