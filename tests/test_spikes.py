import math
import time

import numpy as np

from tracewright.operators.hot_sources import Part, chained
from tracewright.operators.spikes import implausible, innovations, judge, merged


def _lane(n=200, seed=1, level=1000.0, noise=0.08):
    g = np.random.default_rng(seed)
    return np.round(level * np.exp(noise * g.standard_normal(n)) * 8) / 8


def _flags(dur, kind=None, timed=None):
    n = len(dur)
    kind = np.zeros(n, int) if kind is None else kind
    return set(np.flatnonzero(judge(np.array(dur, float), kind, np.ones(n, bool) if timed is None else timed)).tolist())


def test_spikes_and_impossible_values():
    d = _lane()
    d[[20, 50]] = [9000, 60]
    d[[70, 71, 72, 73]] = [math.nan, math.inf, -3, 2e7]
    assert _flags(d) == {20, 50, 70, 71, 72, 73}


def test_stuck_run_with_a_gap_of_impossible_values():
    d = _lane()
    d[100:115] = d[100]
    d[105] = math.nan
    assert _flags(d) == set(range(100, 115))
    d[100:115:2] += 0.125
    d[105] = math.nan
    assert _flags(d) == set(range(100, 115))


def test_normal_behaviour_is_left_alone():
    d = _lane(300)
    mix = np.arange(300) % 3
    assert _flags(d * np.array([1, 2, 5])[mix], mix) == set()
    slow = d.copy()
    slow[::7] *= 6.5
    assert _flags(slow) == set()
    coarse = np.round(d / 90) * 90
    assert _flags(coarse) == set()
    assert _flags(np.full(80, 512.0)) == set()
    drift = d * np.linspace(1, 1.5, 300)
    assert _flags(drift) == set()


def test_spikes_in_a_constant_lane():
    d = np.full(80, 512.0)
    d[[10, 40]] = [1100.0, 300.0]
    assert _flags(d) == {10, 40}


def test_defined_cases(spark):
    d = _lane(60)
    rows = [("t", 1, i, float(i), float(v), "op", "x") for i, v in enumerate(d)]
    rows[5] = ("t", 1, 5, 5.0, 50_000.0, None, "x")
    rows[6] = ("t", 1, 6, None, 60_000.0, "op", "x")
    rows[7] = ("t", 1, 7, 7.0, None, "op", "x")
    rows[8] = ("t", 1, 8, 8.0, math.nan, "op", "x")
    rows += [rows[5], ("t", None, 100, 1.0, -1.0, "op", "x"), ("u", 1, 101, 1.0, -1.0, None, "x"), ("u", 1, 102, 1.0, 5.0, None, "x")]
    df = spark.createDataFrame(rows, "trace_id string, tid int, event_id long, ts double, dur double, op string, __block string")
    args = {"item": "event_id", "time": "ts", "value": "dur", "kind": "op"}
    got = implausible(df, ["trace_id", "tid"], **args)
    assert sorted(map(tuple, got.collect())) == [(5, "far off"), (6, "far off"), (8, "impossible"), (101, "impossible")]
    assert implausible(df.limit(0), ["trace_id", "tid"], **args).count() == 0


def test_hot_source_is_split(spark):
    g = np.random.default_rng(5)
    d = _lane(6000)
    spikes = set(g.choice(6000, 40, replace=False).tolist())
    for i in spikes:
        d[i] = 20_000
    rows = [("t", 1, i, float(i // 2), float(v), "op") for i, v in enumerate(d)] + [("u", 1, 9000 + i, float(i), float(v), "op") for i, v in enumerate(_lane(50, 2))]
    df = spark.createDataFrame(rows, "trace_id string, tid int, event_id long, ts double, dur double, op string")
    got = implausible(df, ["trace_id", "tid"], item="event_id", time="ts", value="dur", kind="op", block_rows=1000)
    assert {r[0] for r in got.collect()} == spikes


def test_runs_across_block_borders_are_seen_whole(spark):
    d = _lane(8000, 7)
    runs = set()
    for a in range(50, 7900, 83):
        d[a : a + 9] = d[a]
        runs |= set(range(a, a + 9))
    rows = [("t", 1, i, float(i), float(v), "op") for i, v in enumerate(d)]
    df = spark.createDataFrame(rows, "trace_id string, tid int, event_id long, ts double, dur double, op string")
    for block_rows in (10**6, 1500, 700):
        got = implausible(df, ["trace_id", "tid"], item="event_id", time="ts", value="dur", kind="op", block_rows=block_rows)
        found = [r[0] for r in got.collect()]
        assert set(found) == runs and len(found) == len(runs)


def test_size_of_a_source_changes_nothing(spark):
    g = np.random.default_rng(11)
    n = 6000
    d = _lane(n, 9)
    kind = np.where(np.arange(n) % 3, "a", "b").astype(object)
    d[kind == "b"] *= 3
    kind[::300] = "rare"  # 20 readings, fewer than 8 in any part of 1000 rows
    kind[7::500] = None
    d[g.choice(n, 30, replace=False)] *= 40
    d[1500:3900] = 777.0  # longer than a part
    d[4100:4112] = d[4100]
    d[[10, 20, 1600]] = [math.nan, -1.0, math.inf]
    d[4500] = 1000.0  # within the range of the others, far from its own
    time = [None if i % 701 == 5 else float(i // 3) for i in range(n)]
    rows = [("t", 1, i, t, float(v), k) for i, (t, v, k) in enumerate(zip(time, d, kind, strict=True))] + [("t", 1, 4500, time[4500], 1000.0, "rare")]
    rows += [("u", 1, 9000 + i, float(i), float(v), "op") for i, v in enumerate(_lane(50, 2))]
    df = spark.createDataFrame(rows, "trace_id string, tid int, event_id long, ts double, dur double, op string")
    args = {"item": "event_id", "time": "ts", "value": "dur", "kind": "op"}
    whole, *in_blocks = (sorted(map(tuple, implausible(df, ["trace_id", "tid"], **args, block_rows=b).collect())) for b in (10**6, 1000, 120))
    assert in_blocks == [whole, whole]
    assert (4500, "far off") in whole and (2500, "stuck") in whole and (1600, "impossible") in whole and (4105, "stuck") in whole


def test_a_sensor_held_with_little_jitter_is_stuck():
    g = np.random.default_rng(3)
    d = _lane(400, 4, noise=0.2)
    d[120:150] = 1000.0 * np.exp(0.001 * g.standard_normal(30))
    d[250:262] = d[250]
    assert _flags(d) == set(range(120, 150)) | set(range(250, 262))
    mix = np.arange(400) % 4  # the run goes on over kinds of different levels
    e = _lane(400, 5) * np.array([1, 3, 9, 20])[mix]
    e[60:90] = 2000.0
    assert _flags(e, mix) == set(range(60, 90))


def test_runs_of_two_bounds_are_merged():
    assert merged([], [(3, 9)]) == [(3, 9)] and merged([(3, 9)], []) == [(3, 9)]
    assert merged([(4, 6), (30, 6), (50, 6)], [(3, 8), (25, 40)]) == [(4, 6), (25, 40)]  # by chance near; mostly wider
    assert merged([(4, 6), (90, 7)], [(2, 13), (20, 10)]) == [(2, 13), (20, 10), (90, 7)]


def test_a_changing_level_is_followed_through_many_batches(spark):
    g = np.random.default_rng(8)
    n = 9000
    d = _lane(n, 6) * np.exp(np.sin(np.arange(n) / 1500) * 0.9)  # up and down by a factor of six, slowly
    spikes = set(g.choice(n, 30, replace=False).tolist())
    for i in spikes:
        d[i] *= 30
    rows = [("t", 1, i, float(i), float(v), "op") for i, v in enumerate(d)]
    df = spark.createDataFrame(rows, "trace_id string, tid int, event_id long, ts double, dur double, op string")
    args = {"item": "event_id", "time": "ts", "value": "dur", "kind": "op"}
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in (10_000, 170):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            for block_rows in (10**6, 1000):
                got = implausible(df, ["trace_id", "tid"], **args, block_rows=block_rows).collect()
                assert {r[0] for r in got} == spikes and len(got) == len(spikes)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_many_runs_and_many_kinds_are_judged_once():
    g = np.random.default_rng(2)
    d = _lane(60_000, 10)
    for a in range(10, 59_900, 29):
        d[a : a + 7] = d[a]
    began = time.process_time()
    assert len(_flags(d)) > 10_000
    assert len(_flags(_lane(60_000, 11), g.integers(0, 20_000, 60_000))) < 50
    assert time.process_time() - began < 30


def test_runs_are_joined_over_blocks():
    x = np.concatenate([[5.0, 9.0], np.full(14, 700.0), [20.0, 700.0, 700.0], np.full(6, 31.0)])
    e = innovations(x)
    for size in (1, 2, 3, 5, 7, 25):
        parts, prev = [], np.nan
        for a in range(0, len(x), size):
            part = Part(0.1, prev)
            b = x[a : a + size]
            part.add(b, ["k"] * len(b), np.arange(a, a + len(b), dtype=float), list(range(a, a + len(b))), np.ones(len(b), bool))
            parts.append(part.told())
            prev = b[-1]
        for level in (0, 1):
            runs, near = chained(parts, level)
            assert [(r.start, r.n, r.first[1], r.last[1], dict(r.tally)) for r in runs] == [(2, 14, 2, 15, {("k", 700.0): 14}), (19, 6, 19, 24, {("k", 31.0): 6})]
            assert near == int((np.abs(e[1:]) < 1e-9).sum()) and all(r.squares == 0 for r in runs)


def test_a_level_that_jumps_for_good_is_the_level_after_some_readings():
    d = np.concatenate([_lane(300, 20, level=500.0), _lane(300, 21, level=4000.0)])
    d[[100, 450]] = [9000.0, 90_000.0]
    got = _flags(d)
    assert {100, 450} <= got and got - {100, 450} == set(range(300, 308))
