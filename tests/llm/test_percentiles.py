import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import percentiles as P
from tracewright.plans import durable

QS = [0.0, 0.01, 0.5, 0.95, 1.0]


def _brute(rows, qs=QS):
    groups = {}
    for g, v, i, *_ in rows:
        if v is not None and math.isfinite(v):
            groups.setdefault(g, {})[i] = v
    out = []
    for g, items in groups.items():
        s = sorted(items.values())
        out += [(str(g), q, len(s), s[max(1, math.ceil(q * len(s) - 1e-9)) - 1]) for q in qs]
    return sorted(out)


def _got(summary, qs=QS, **kw):
    return sorted((str(r[0]), r["q"], r["n_readings"], r["value"]) for r in P.percentiles(summary, qs, **kw).collect())


def _frame(spark, rows):
    return spark.createDataFrame(rows, "q string, x double, id long, v int, n int")


def test_agrees_with_sorting(spark, monkeypatch):
    r = random.Random(1)
    value = lambda: r.choice([None, math.nan, math.inf, 0.0, -r.expovariate(1e-3), r.lognormvariate(0, 6), r.randrange(9) * 1.0, 1 + r.random() * 1e-12, 1e308, -1e308, 5e-324])
    rows = [(r.choice(["a", "a", "a", "b", None]), value(), i, 0, 0) for i in range(700)] + [("one", 3.5, 9000, 0, 0), ("nothing", None, 9001, 0, 0)]
    rows += rows[:100]
    summary = P.summarize(_frame(spark, rows), ["q"], "x", "id")
    assert _got(summary) == _brute(rows)
    assert _got(summary, heavy_rows=0) == _got(summary, heavy_rows=200) == _brute(rows)  # all groups hot, some
    assert _got(summary, at_least=100) == _got(summary, at_least=100, heavy_rows=0) == [r for r in _brute(rows) if r[2] >= 100]
    monkeypatch.setattr(durable, "BROADCAST_BYTES", 1)  # joins that shuffle
    assert _got(summary, heavy_rows=100) == _brute(rows)
    assert P.percentiles(summary, [0.5]).columns == ["q_", "q", "n_readings", "value"]


def test_parts_combine(spark):
    r = random.Random(2)
    rows = [("g", r.lognormvariate(3, 1), i, 0, 0) for i in range(900)]
    parts = [P.summarize(_frame(spark, rows[k::3]), ["q"], "x", "id") for k in range(3)]
    assert _got(P.combine(*parts)) == _got(P.combine(P.combine(parts[2], parts[0]), parts[1])) == _brute(rows)


def test_days_roll_up(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), r.lognormvariate(3, 1), i, i % 5, 0) for i in range(600)]
    by_day = P.summarize(_frame(spark, rows), ["v", "q"], "x", "id")
    assert _got(P.roll_up(by_day, ["q"])) == _got(P.roll_up(by_day.compact(), ["q"])) == _brute(rows)
    again = P.summarize(_frame(spark, rows + rows[:90]), ["v", "q"], "x", "id")
    assert _got(P.roll_up(again, ["q"])) == _got(P.roll_up(again.compact(), ["q"])) == _brute(rows)


def test_smallest_and_largest_values(spark):
    values = [1e-322, 1.05e-322, 1.1e-322, 1.7e308, 1.75e308, 1.79e308, -1.7e308, -1.75e308, 0.0, -0.0]
    rows = [("g", v, i, 0, 0) for i, v in enumerate(values)]
    qs = [0.1, 0.2, 0.3, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
    summary = P.summarize(_frame(spark, rows), ["q"], "x", "id")
    assert _got(summary, qs) == _got(summary, qs, heavy_rows=0) == _brute(rows, qs)


def test_empty(spark):
    assert _got(P.summarize(_frame(spark, []), ["q"], "x")) == []


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=40))
def test_any_values(spark, values):
    rows = [("g", v, i, 0, 0) for i, v in enumerate(values)]
    assert _got(P.summarize(_frame(spark, rows), ["q"], "x", "id"), [0.25, 0.5]) == _brute(rows, [0.25, 0.5])
