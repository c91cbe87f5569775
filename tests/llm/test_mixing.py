import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm.mixing import fly, land, mix


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 0.99), st.integers(1, 500)), min_size=1, max_size=60), st.integers(0, 99))
def test_flight_keeps_both_totals(units, seed):
    p, size = np.array([u[0] for u in units]), np.array([float(u[1]) for u in units])
    q = fly(p, size, np.random.default_rng(seed).random(100))
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert abs(q.sum() - p.sum()) < 1e-5 and abs(q @ size - p @ size) < 1e-3 * max(1, size.max())
    assert set(np.unique(land(q, size))) <= {0.0, 1.0}


def test_flight_keeps_every_documents_chance():
    p, size = np.full(12, 0.25), np.arange(1.0, 13.0)
    mean = sum(fly(p, size, np.random.default_rng(s).random(50)) for s in range(4000)) / 4000
    assert np.abs(mean - 0.25).max() < 0.03


def _docs(spark, n=4000):
    g = np.random.default_rng(1)
    rows = [(i, " Big " if i % 2 else "big", int(g.integers(1, 900))) for i in range(n)]
    rows += [(10_000 + i, "small", 100) for i in range(20)] + [(20_000, None, 50), (20_001, "other", 60), (20_002, "big", None), (20_003, "big", 0)]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")


TARGETS = [("BIG", 0.6, 1), ("small", 0.3, 4), ("none", 0.1, 2)]


@pytest.mark.parametrize("block", [16, 8192])
def test_mixture(spark, block):
    docs = _docs(spark).withColumn("repeats", docs_extra())
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    chosen, report = mix(docs, targets, block=block)
    r = {x["source"]: x for x in report.collect()}
    total = docs.agg({"n_tokens": "sum"}).first()[0]
    assert r["big"]["target_tokens"] == pytest.approx(0.6 * total)
    assert abs(r["big"]["reached_tokens"] - 0.6 * total) < 900 and not r["big"]["short"]
    assert (r["small"]["reached_tokens"], r["small"]["short"], r["none"]["short"]) == (8000, True, True)
    assert sum(x["reached_share"] for x in r.values()) == pytest.approx(1)
    rows = chosen.collect()
    assert len({x["doc_id"] for x in rows}) == len(rows) and all(x["n_tokens"] > 0 for x in rows)
    assert max(x["repeats"] for x in rows if x["source"] == "big") == 1
    assert sorted((x["doc_id"], x["repeats"]) for x in mix(docs, targets, block=block)[0].collect()) == sorted((x["doc_id"], x["repeats"]) for x in rows)


def docs_extra():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_whole_repeats_and_one_more(spark):
    docs = spark.createDataFrame([(i, "a", 10) for i in range(100)] + [(1000 + i, "b", 10) for i in range(300)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.63, 3), ("b", 0.37, 1)], "source string, target_share double, max_repeats int")
    chosen, report = mix(docs, targets)
    a = [x["repeats"] for x in chosen.where("source = 'a'").collect()]
    assert sum(a) == 252 and set(a) == {2, 3}
    with pytest.raises(ValueError):
        mix(docs, targets.unionByName(targets))


def test_empty(spark):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    chosen, report = mix(_docs(spark).limit(0), targets)
    assert chosen.count() == 0
    assert {(x["source"], x["reached_share"], x["short"]) for x in report.collect()} == {("big", 0.0, False), ("small", 0.0, False), ("none", 0.0, False)}
