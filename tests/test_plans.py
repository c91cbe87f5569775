import pytest

from tracewright.plans import durable, once
from tracewright.plans.names import carried
from tracewright.plans.skew import keep_keys


def test_once(spark, monkeypatch):
    rows = [(1, "a"), (1, "a"), (2, "b"), (None, "c"), (None, "c"), (3, "d"), (3, "d"), (3, "d")]
    df = spark.createDataFrame(rows, "k long, x string")
    want = [("1", "a"), ("2", "b"), ("3", "d"), ("None", "c"), ("None", "c")]
    key = lambda d: sorted((str(r["k"]), r["x"]) for r in d.collect())
    assert key(once.once(df, "k")) == want
    monkeypatch.setattr(durable, "BROADCAST_BYTES", 1)
    assert key(once.once(df, "k")) == want
    assert once.once(df.where("k = 2"), "k").count() == 1
    assert once.once(df.limit(0), "k").count() == 0


def test_marked_repeats(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c"), (None, "c")], "k long, x string")
    want = [("a", "1"), ("a", "1"), ("b", None), ("c", None), ("c", None)]
    got = lambda: sorted(((r["x"], r["m"]) for r in once.marked_repeats(df, "k", "m").collect()), key=str)
    assert got() == want and once.marked_repeats(df.where("k = 2"), "k", "m").first()["m"] is None
    monkeypatch.setattr(durable, "BROADCAST_BYTES", 1)
    assert got() == want


def test_cut_reads_what_it_wrote(spark):
    df = spark.range(10).selectExpr("id", "CAST(NULL AS STRING) AS x")
    back = durable.cut(df)
    assert back.schema.names == ["id", "x"] and back.count() == 10
    assert durable.cut(df.limit(0)).count() == 0
    durable.discard(back)
    with pytest.raises(Exception):
        back.count()


def test_carried_names():
    assert carried(["a", "b", "A_"], ["a"]) == ["a_", "b", "A__"]


def test_keep_keys_broadcasts_hot_ones_only(spark, monkeypatch):
    big = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 9 + [2, 3, 3, None])], "k long, i int")
    keys = spark.createDataFrame([(1, 9), (3, 2)], "k long, n long")
    want = sorted(r["i"] for r in big.where("k IN (1, 3)").collect())
    assert sorted(r["i"] for r in keep_keys(big, keys, "k", 2, "n").collect()) == want
    monkeypatch.setattr(durable, "BROADCAST_BYTES", 60)
    assert sorted(r["i"] for r in keep_keys(big, keys, "k", 2, "n", hot_rows=5).collect()) == want
    monkeypatch.setattr(durable, "BROADCAST_BYTES", 1)
    assert sorted(r["i"] for r in keep_keys(big, keys, "k", 2, "n", hot_rows=5).collect()) == want


def test_cuts_are_deleted_when_released_also_after_the_session(spark):
    back = durable.cut(spark.range(3))
    durable.release()
    with pytest.raises(Exception):
        back.count()
    assert not durable._written
