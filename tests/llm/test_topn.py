import random

import pytest

from tracewright.llm.topn import top_n_per_group


def _brute(rows, n):
    groups = {}
    for g, score, t, i, *_ in rows:
        groups.setdefault(g, set()).add((score is None, -(score or 0), t, i))
    return sorted((str(g), place + 1, x[3]) for g, s in groups.items() for place, x in enumerate(sorted(s)[:n]))


def _got(df, n, **kw):
    out = top_n_per_group(df, ["g"], [("score", True), ("t", False), ("id", False)], n, **kw)
    return sorted((str(r["g"]), r["place"], r["id"]) for r in out.collect()), out


@pytest.mark.parametrize("heavy", [10**9, 20, 0])
def test_hot_and_cold_agree_with_brute_force(spark, heavy):
    r = random.Random(heavy)
    rows = [(r.choice(["hot"] * 6 + ["a", "b", None]), r.choice([None, 1.0, 2.0, 2.0, float(r.randrange(50))]), r.randrange(3), i, "x", "y") for i in range(600)]
    rows += [("flat", 1.0, 0, 1000 + i, "x", "y") for i in range(200)]
    rows += rows[:50]
    df = spark.createDataFrame(rows, "g string, score double, t int, id long, place string, __rows string")
    got, out = _got(df, 3, heavy_rows=heavy, ranges=8, salts=4)
    assert got == _brute(rows, 3)
    assert "place_" in out.columns


def test_empty(spark):
    df = spark.createDataFrame([], "g string, score double, t int, id long")
    assert _got(df, 3)[0] == []
