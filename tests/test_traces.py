import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tracewright.operators import layout, metrics, trace
from tracewright.operators.graph import PipelineGraph
from tracewright.operators.simulate import simulate
from tracewright.operators.trace import set_times
from tracewright.plans.flow import FlowGraph, FlowNode
from tracewright.sources import svg
from tracewright.sources.profiler import ProfilerJson, ProfilerJsonLines, ProfilerSqlite, ProfilerTable
from tracewright.streaming.utilisation import device_load

DOC = {
    "distributedInfo": {"world_size": 2, "other": 1},
    "traceEvents": [
        {"name": "forward_step-0-0", "tid": 0, "ts": 1.5, "dur": 2},
        {"name": "idle"},
        {"name": "backward_step-0-0", "tid": "1", "ts": 4, "dur": 3.25, "more": [1]},
    ],
}


def test_profiler_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(DOC, indent=1))
    source = ProfilerJson(str(tmp_path))
    rows = source.read(spark, ["FWD", "BWD", "WGT"]).orderBy("seq").collect()
    assert [(r["event_num"], r["dev_id"], r["event_type"], r["ts"], r["dur"]) for r in rows] == [(1, 0, "FWD", 1.5, 2.0), (3, 1, "BWD", 4.0, 3.25)]
    assert source.read(spark, ["WGT"]).count() == 0
    assert len(source.outputs) == 2
    DOC2 = DOC | {"distributedInfo": {"world_size": 1}}
    (tmp_path / "a.json").write_text(json.dumps(DOC2))
    with pytest.raises(Exception, match="outside of the trace"):
        ProfilerJson(str(tmp_path)).read(spark, ["BWD"]).collect()


def test_profiler_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text("name,tid,ts,dur\nforward_step-1,0,1,2\nx,0,1,2\n")
    assert ProfilerTable(str(tmp_path / "t.csv")).read(spark, ["FWD"]).count() == 1


def test_documents_are_written_and_read_again(spark, tmp_path):
    t = _trace(spark)
    ProfilerJsonLines(str(tmp_path / "out")).write(t)
    back = ProfilerJson(str(tmp_path / "out"), lines=True).read(spark, ["FWD", "BWD"])
    key = lambda d: sorted((r["dev_id"], r["event_type"], float(r["ts"]), float(r["dur"])) for r in d.collect())
    assert key(back) == key(t)


def _trace(spark):
    g = PipelineGraph.build(spark, "g", "gpipe", 2, 2, fwd_time=3, bwd_time=4)
    return simulate(g.nodes, g.edges)


def test_device_lists(spark):
    t = _trace(spark)
    assert [r["event_num"] for r in trace.device_events(t, 1, 2).collect()] == [3, 4, 7, 8]
    for bad in (-1, 2):
        with pytest.raises(KeyError):
            trace.device_events(t, bad, 2)
    sizes = spark.createDataFrame([("g", 3)], "trace_id string, ndevs int")
    assert {r["dev_id"]: r["n_events"] for r in trace.device_counts(t, sizes).collect()} == {0: 4, 1: 4, 2: 0}
    twice = trace.add_events(t, t)
    assert sorted(r["seq"] for r in twice.where("dev_id = 0").collect()) == list(range(8))
    assert trace.add_events(trace.empty_trace(spark), t).count() == 8
    assert trace.equal_events(t, t).count() == 8


def test_metrics(spark):
    t = _trace(spark)
    assert metrics.makespan(t).first()["makespan"] == 21
    b = metrics.bubble(t, spark.createDataFrame([("g", 2)], "trace_id string, nstages int")).first()
    assert (b["busy"], round(b["bubble_ratio"], 6)) == (28, round(1 - 28 / 42, 6))
    gaps = {(r["dev_id"], r["gap_start"], r["gap_end"]) for r in metrics.idle_gaps(t).collect()}
    assert gaps == {(0, 6, 13), (1, 0, 3)}
    assert {r["event_type"]: r["total"] for r in metrics.phase_times(t).collect()} == {"FWD": 12, "BWD": 16}


def test_drawing(spark, tmp_path):
    t = _trace(spark)
    assert svg.draw(t, str(tmp_path / "t.svg")) == 8
    text = (tmp_path / "t.svg").read_text()
    assert text.count("<rect") == 10 and "Device 1" in text and "#397af2" in text
    with pytest.raises(ValueError):
        svg.draw(t.limit(0), str(tmp_path / "e.svg"))
    assert layout.summary(t.withColumn("name", F.lit(""))).first()["canvas_width"] is None


def test_workflow(spark):
    flow = FlowGraph()
    flow.add_node(FlowNode("numbers", 0, lambda _: spark.range(5)))
    flow.add_node(FlowNode("double", 1, lambda i: i[0].select((F.col("id") * 2).alias("id"))))
    flow.add_node(FlowNode("sum", 2, lambda i: i[0].agg(F.sum("id").alias("s")), needs=spark.range(1).schema))
    flow.add_edge(0, 1), flow.add_edge(1, 2)
    assert flow.run()[2][0].first()["s"] == 20
    assert [str(n) for n in flow.next_nodes(0)] == ["FlowNode(1: double)"]
    with pytest.raises(KeyError):
        flow.add_edge(0, 9)
    flow.add_edge(2, 0)
    with pytest.raises(ValueError, match="cycle"):
        flow.run()
    bad = FlowGraph()
    bad.add_node(FlowNode("a", 0, lambda _: spark.range(2).toDF("x")))
    bad.add_node(FlowNode("b", 1, needs=spark.range(1).schema))
    bad.add_edge(0, 1)
    with pytest.raises(TypeError):
        bad.run()


def test_steps(spark, tmp_path):
    from tracewright.operators import steps

    g = PipelineGraph.build(spark, "g", "gpipe", 2, 2, fwd_time=3, bwd_time=4)
    flow = FlowGraph()
    flow.add_node(FlowNode("whole", 0, lambda _: g))
    for n in (steps.filter_step(1, [0]), steps.filter_step(2, [1])):
        flow.add_node(n)
    cut = [(("FWD", 0, m, 0), ("FWD", 1, m, 0)) for m in (0, 1)] + [(("BWD", 1, m, 0), ("BWD", 0, m, 0)) for m in (0, 1)]
    flow.add_node(steps.merge_step(3, "m", cut))
    flow.add_node(steps.simulate_step(4))
    flow.add_node(steps.draw_step(5, str(tmp_path / "t.svg")))
    for a, b in ((0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 5)):
        flow.add_edge(a, b)
    out = flow.run()
    assert out[5] == [8] and metrics.makespan(out[4][0]).first()["makespan"] == 21
    s = steps.simulator("pp")
    with pytest.raises(RuntimeError):
        s.perf()
    s.run(g)
    assert s.perf()["makespan"] == 21
    with pytest.raises(NotImplementedError):
        steps.simulator("dp")
    with pytest.raises(ValueError):
        steps.simulator("other")


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = [("t", "1", i % 7, 2.0, f"2025-01-01 0{i % 3}:10:00") for i in range(12)]
    df = spark.createDataFrame(rows, "trace_id string, tid string, event_id long, dur double, at string").withColumn("captured_at", F.to_timestamp("at")).drop("at")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = device_load(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("load").start()
    q.processAllAvailable()
    q.stop()
    key = lambda d: sorted((str(r["window_start"]), r["busy_us"], r["n_events"]) for r in d.collect())
    assert key(spark.table("load")) == key(device_load(df))


def test_sqlite_export_is_read_in_ranges(spark, tmp_path):
    path = str(tmp_path / "an export.sqlite")
    with sqlite3.connect(path) as con:
        con.execute('CREATE TABLE "k" (label TEXT, tid INT, ts REAL, dur REAL)')
        rows = [(f"{'forward_step' if i % 3 else 'other'}-{i}", i % 4, i * 1.5, None if i == 7 else 2) for i in range(100)]
        con.executemany('INSERT INTO "k" VALUES (?, ?, ?, ?)', rows)
        con.execute('DELETE FROM "k" WHERE rowid = 3')
    want = [(i % 4, i, f"forward_step-{i}", i * 1.5, None if i == 7 else 2.0) for i in range(100) if i % 3 and i != 2]
    for step in (7, 1000):
        got = ProfilerSqlite(path, "k", {"name": "label"}, rows=step).read(spark, ["FWD"])
        assert [tuple(r) for r in got.select("dev_id", "seq", "name", "ts", "dur").orderBy("seq").collect()] == want
    with sqlite3.connect(path) as con:
        con.execute('DELETE FROM "k"')
    assert ProfilerSqlite(path, "k", {"name": "label"}).read(spark, ["FWD"]).count() == 0


def test_the_place_of_a_row_does_not_depend_on_splits(spark, tmp_path):
    rows = [(f"forward_step-{i}", str(i % 4), float(i), 2.0) for i in range(5000)]
    spark.createDataFrame(rows, "name string, tid string, ts double, dur double").coalesce(1).write.option("header", True).csv(str(tmp_path / "t.csv"))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (was, "9000", "20000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = ProfilerTable(str(tmp_path / "t.csv")).read(spark, ["FWD"])
            assert got.where("name <> 'forward_step-' || seq").count() == 0 and got.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_times_must_be_numbers(spark):
    t = spark.createDataFrame([("t", 1, 2)], "trace_id string, ts long, dur long")
    assert tuple(set_times(t, F.col("ts") + 1, F.lit(2.0)).first()) == ("t", 2, 2)
    with pytest.raises(TypeError):
        set_times(t, F.lit("now"))
