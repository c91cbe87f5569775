import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.operators import graph, metrics, trace
from tracewright.operators.graph import PipelineGraph, merge_graphs
from tracewright.operators.simulate import run_schedule, simulate, simulate_any, simulate_configs, simulate_waves, unreached

COST = {"fwd_time": 5478, "bwd_time": 5806, "wgt_time": 3534}


def _makespan(g):
    return metrics.makespan(simulate(g.nodes, g.edges)).first()["makespan"]


@pytest.mark.parametrize(
    ("schedule", "s", "m", "c", "eager", "want"),
    [
        ("gpipe", 4, 10, 1, False, 146692), ("pipedream", 4, 10, 1, False, 146692), ("pipedream", 4, 10, 1, True, 146692),
        ("interleaved", 4, 12, 2, False, 304668), ("interleaved", 4, 10, 2, False, 259532), ("zb", 4, 5, 2, False, 187510),
        ("zb", 4, 10, 2, False, 335690), ("zbv", 4, 15, 2, False, 474858),
    ],
)
def test_makespans(spark, schedule, s, m, c, eager, want):
    g = PipelineGraph.build(spark, "g", schedule, s, m, c, eager=eager, **COST)
    assert _makespan(g) == want


@pytest.mark.parametrize(
    ("schedule", "s", "m", "c", "cut", "one", "two", "edges", "want"),
    [
        ("gpipe", 4, 10, 1, 2, (1000, 2000, 3000), (2000, 1000, 3000), 136, 48000),
        ("pipedream", 4, 10, 1, 2, (1000, 2000, 3000), (2000, 1000, 3000), 122, 39000),
        ("interleaved", 4, 12, 2, 2, (1000, 2000, 3000), (2000, 1000, 3000), 300, 85000),
        ("zb", 4, 10, 2, 2, (1000, 2000, 3000), (3000, 2000, 1000), 446, 161000),
        ("zbv", 4, 10, 2, 2, (1000, 2000, 3000), (3000, 2000, 1000), 446, 148000),
        ("zbv", 8, 10, 2, 4, (1315, 2733, 2650), (2743, 4563, 4324), 902, 281144),
    ],
)
def test_mixed_hardware(spark, schedule, s, m, c, cut, one, two, edges, want):
    from tracewright.operators.schedules import config_frame

    build = lambda cost: PipelineGraph.build(spark, "g", schedule, s, m, c, fwd_time=cost[0], bwd_time=cost[1], wgt_time=cost[2])
    a, b = build(one).filter(list(range(cut))), build(two).filter(list(range(cut, s)))
    row = {"graph_id": "m", "schedule": schedule, "nstages": s, "nmicrobatches": m, "nchunks": c, "fwd_time": 1, "bwd_time": 1}
    g = merge_graphs("m", [a, b], graph.cut_edges(config_frame(spark, [row]), cut))
    assert g.edges.count() == edges
    assert _makespan(g) == want


def test_nodes_without_predecessors_start_at_zero(spark):
    g = PipelineGraph.build(spark, "g", "zb", 4, 10, 2, **COST).filter([2, 3])
    t = simulate(g.nodes, g.edges)
    assert t.where("ts = 0").count() == 3
    assert _makespan(g) == 298632


def test_order_of_execution(spark):
    g = PipelineGraph.build(spark, "g", "pipedream", 4, 3, 1, eager=True, **COST)
    info = {r["dev_id"]: r["info"] for r in trace.info_strings(simulate(g.nodes, g.edges)).collect()}
    assert info[3] == "[<Event 10:F:0-0>, <Event 22:B:0-0>, <Event 11:F:1-0>, <Event 23:B:1-0>, <Event 12:F:2-0>, <Event 24:B:2-0>]"


def test_waves_agree_with_the_kernel(spark):
    g = PipelineGraph.build(spark, "g", "zb", 2, 2, 2, **COST)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(simulate_waves(g.nodes, g.edges)) == rows(simulate(g.nodes, g.edges))


def test_sweeps_agree_with_single_scenarios(spark):
    from tracewright.operators.schedules import config_frame, graph_edges, graph_nodes

    shapes = [("gpipe", 3, 4, 1, False), ("pipedream", 3, 5, 1, True), ("interleaved", 2, 5, 2, False), ("zb", 2, 3, 2, False), ("zbv", 3, 2, 4, False)]
    rows = [
        {"graph_id": f"{i}-{k}", "schedule": s, "nstages": n, "nmicrobatches": m, "nchunks": c, "eager": e, "fwd_time": 3 + k, "bwd_time": 9 - k, "wgt_time": k * k}
        for i, (s, n, m, c, e) in enumerate(shapes)
        for k in range(4)
    ]
    configs = config_frame(spark, rows)
    want = sorted(tuple(r) for r in simulate(graph_nodes(configs), graph_edges(configs)).collect())
    for bound in (10**6, 10):
        assert sorted(tuple(r) for r in simulate_configs(configs, bound).collect()) == want
    assert simulate_configs(configs.limit(0)).count() == 0


def test_cycles_stay_out_and_dirty_rows_count_once(spark):
    g = PipelineGraph.build(spark, "g", "gpipe", 2, 2, fwd_time=3, bwd_time=4)
    back = g.add_edges([(("BWD", 0, 1, 0), ("BWD", 0, 0, 0))])
    t = simulate(back.nodes.unionByName(back.nodes), back.edges.unionByName(back.edges))
    assert unreached(back.nodes, t).count() == 2
    nodes = g.nodes.selectExpr("graph_id", "event_num", "event_type", "stage_id", "microbatch_id", "chunk_id", "name", "ts", "CAST(NULL AS BIGINT) AS dur")
    assert metrics.makespan(simulate(nodes, g.edges)).first()["makespan"] == 0
    assert simulate(g.nodes.limit(0), g.edges.limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 25), st.integers(1, 4), st.integers(0, 10**6))
def test_any_graph(n, stages, seed):
    r = random.Random(seed)
    nodes = pd.DataFrame({"event_num": range(1, n + 1), "stage_id": [r.randrange(stages) for _ in range(n)], "dur": [r.randrange(9) for _ in range(n)]})
    pairs = [(a, b) for a in range(1, n + 1) for b in range(a + 1, n + 1) if r.random() < 0.15]
    out = run_schedule(nodes, pd.DataFrame(pairs, columns=["src_num", "dst_num"])).set_index("event_num")
    assert len(out) == n
    end = out["ts"] + out["dur"]
    heads = set(range(1, n + 1)) - {b for _, b in pairs}
    assert all(out["ts"][b] >= end[a] for a, b in pairs)
    assert all(out["ts"][h] == 0 for h in heads)
    for _, stage in out.groupby("stage_id"):
        stage = stage.sort_values("seq")
        ends = (stage["ts"] + stage["dur"]).shift()
        later = [i not in heads for i in stage.index]
        assert (stage["ts"][later] >= ends.fillna(0)[later]).all()


def test_graphs_too_large_for_a_task_go_by_waves(spark):
    a = PipelineGraph.build(spark, "a", "gpipe", 2, 3, **COST)
    b = PipelineGraph.build(spark, "b", "zb", 3, 4, 2, **COST)
    nodes, edges = a.nodes.unionByName(b.nodes), a.edges.unionByName(b.edges)
    want = sorted(simulate(nodes, edges).collect())
    for task_nodes in (0, 20, 10**6):
        assert sorted(simulate_any(nodes, edges, task_nodes).collect()) == want
