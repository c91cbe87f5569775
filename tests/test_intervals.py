import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.operators.intervals import dyadic_blocks, merge_intervals, runs_of


def _plain(rows):
    out = []
    for s, e in sorted(rows):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 250), st.integers(1, 60)), min_size=1, max_size=40))
def test_kernel(rows):
    iv = [(s, min(256, s + d)) for s, d in rows if s < min(256, s + d)]
    s, e = (np.array(x, np.int64) for x in zip(*iv, strict=True))
    a, b = runs_of(np.zeros(len(s), np.int64), s, e, 8)
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == _plain(iv)


def test_blocks_are_canonical():
    s, k = dyadic_blocks(np.zeros(1, np.int64), np.array([3], np.int64), np.array([17], np.int64))
    assert sorted(zip(s.tolist(), k.tolist(), strict=True)) == [(3, 0), (4, 2), (8, 3), (16, 0)]


def _run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "e string, s long, t long, __cell string, kind string")
    out = merge_intervals(df, ["e"], "s", "t", **kw)
    return sorted(((r["e"] or "", r["kind"], r["s"], r["t"]) for r in out.collect()))


def test_defined_cases(spark):
    rows = [("a", 0, 4, None, "x"), ("a", 4, 6, None, "x"), ("a", 10, 12, "q", None), ("a", 10, 12, "q", None), ("a", None, 5, None, None),
            ("a", 7, 7, None, None), ("a", 9, 8, None, None), (None, -5, -2, None, None), (None, 3, 4, None, None)]
    want = [("", "busy", -5, -2), ("", "busy", 3, 4), ("", "gap", -2, 3), ("a", "busy", 0, 6), ("a", "busy", 10, 12), ("a", "gap", 6, 10)]
    assert _run(spark, rows) == want
    assert _run(spark, rows, cell_bits=2, super_bits=1) == want
    assert _run(spark, []) == []


def test_cells_and_super_cells(spark):
    r = random.Random(3)
    rows = []
    for e in "abc":
        for _ in range(300):
            s = r.randrange(-5000, 5000)
            rows.append((e, s, s + 1 + r.randrange(r.choice([3, 40, 900])), None, None))
    want = []
    for e in "abc":
        runs = _plain([(s, t) for k, s, t, *_ in rows if k == e])
        want += [(e, "busy", *x) for x in runs] + [(e, "gap", a[1], b[0]) for a, b in zip(runs, runs[1:], strict=False)]
    for bits, sup in ((4, 2), (7, 1), (33, 12)):
        assert _run(spark, rows, cell_bits=bits, super_bits=sup) == sorted(want)


def test_long_intervals_make_few_pieces(spark):
    rows = [("a", 0, 1 << 60, None, None), ("a", (1 << 60) + 5, (1 << 60) + 9, None, None), ("a", 77, 99, None, None), ("a", 1 << 50, (1 << 50) + 3, None, None),
            ("b", -(1 << 45), 1 << 45, None, None), ("b", (1 << 45) + (1 << 40), (1 << 45) + (1 << 41), None, None), ("b", 5, 6, None, None),
            (None, -(1 << 62), -(1 << 61), None, None), (None, -(1 << 61), 3, None, None), ("c", -(1 << 63), (1 << 63) - 1, None, None), ("c", 1, 2, None, None)]
    t = 1 << 45
    assert _run(spark, rows) == [
        ("", "busy", -(1 << 62), 3), ("a", "busy", 0, 1 << 60), ("a", "busy", (1 << 60) + 5, (1 << 60) + 9), ("a", "gap", 1 << 60, (1 << 60) + 5),
        ("b", "busy", -t, t), ("b", "busy", t + (1 << 40), t + (1 << 41)), ("b", "gap", t, t + (1 << 40)), ("c", "busy", -(1 << 63), (1 << 63) - 1),
    ]


def test_levels_of_blocks(spark):
    """Intervals of all lengths, against the plain merge, with small cells."""
    r = random.Random(8)
    rows = []
    for e in "abcdef":
        for _ in range(60):
            s = r.randrange(-4000, 4000)
            rows.append((e, s, s + 1 + r.randrange(r.choice([2, 9, 60, 300 if e > "c" else 5])), None, None))
    want = []
    for e in "abcdef":
        runs = _plain([(s, t) for k, s, t, *_ in rows if k == e])
        want += [(e, "busy", *x) for x in runs] + [(e, "gap", a[1], b[0]) for a, b in zip(runs, runs[1:], strict=False)]
    for bits, sup in ((2, 1), (3, 2), (5, 3)):
        assert _run(spark, rows, cell_bits=bits, super_bits=sup) == sorted(want)
