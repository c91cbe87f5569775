import pytest

from tracewright.model import PipeCost, PipePartition, check_event_type, event_name
from tracewright.operators import graph
from tracewright.operators.graph import PipelineGraph, merge_graphs
from tracewright.operators.schedules import config_frame, graph_edges, graph_nodes

# nodes and edges of known shapes
SIZES = [
    ("gpipe", 4, 10, 1, False, 80, 136),
    ("pipedream", 4, 10, 1, False, 80, 115),
    ("pipedream", 4, 10, 1, True, 80, 121),
    ("interleaved", 4, 12, 2, False, 192, 284),
    ("interleaved", 4, 10, 2, False, 160, 240),
    ("zb", 4, 5, 2, False, 120, 211),
    ("zb", 4, 10, 2, False, 240, 446),
    ("zbv", 4, 15, 2, False, 360, 681),
]


def test_sizes(spark):
    rows = [
        {"graph_id": str(i), "schedule": s, "nstages": n, "nmicrobatches": m, "nchunks": c, "eager": e, "fwd_time": 1, "bwd_time": 1}
        for i, (s, n, m, c, e, _, _) in enumerate(SIZES)
    ]
    configs = config_frame(spark, rows)
    nodes = {r["graph_id"]: r["count"] for r in graph_nodes(configs).groupBy("graph_id").count().collect()}
    edges = graph_edges(configs)
    found = {r["graph_id"]: r["count"] for r in edges.distinct().groupBy("graph_id").count().collect()}
    assert [(nodes[str(i)], found[str(i)]) for i in range(len(SIZES))] == [x[5:] for x in SIZES]
    assert edges.count() == sum(found.values())
    assert graph.dangling_edges(graph_nodes(configs), edges).count() == 0


def test_no_dangling_edges_in_small_shapes(spark):
    rows = [
        {"graph_id": f"{s}-{m}-{c}", "schedule": "interleaved", "nstages": s, "nmicrobatches": m, "nchunks": c, "fwd_time": 1, "bwd_time": 1}
        for s in (1, 2, 3, 4)
        for m in range(1, 9)
        for c in (1, 2, 3)
        if s * (c - 1) + 2 * s - 2 < m * c
    ]
    configs = config_frame(spark, rows)
    assert graph.dangling_edges(graph_nodes(configs), graph_edges(configs, ["interleaved"])).count() == 0


def test_strict_data_deps_add_edges_between_chunks(spark):
    c = config_frame(spark, [{"graph_id": "i", "schedule": "interleaved", "nstages": 4, "nmicrobatches": 12, "nchunks": 2, "fwd_time": 1, "bwd_time": 1}])
    assert graph_edges(c, ["interleaved"], strict_data_deps=True).distinct().count() == 284 + 24


def test_configurations_are_checked(spark):
    ok = {"graph_id": "g", "schedule": "gpipe", "nstages": 2, "nmicrobatches": 2, "fwd_time": 1, "bwd_time": 1}
    with pytest.raises(AssertionError):
        config_frame(spark, [ok | {"nchunks": 2}])
    with pytest.raises(ValueError):
        config_frame(spark, [ok | {"schedule": "zbv", "nchunks": 3}])
    with pytest.raises(ValueError):
        config_frame(spark, [ok | {"schedule": "other"}])
    with pytest.raises(ValueError):
        config_frame(spark, [ok | {"fwd_time": None}])
    for bad in (True, 1.0):
        with pytest.raises(TypeError):
            PipeCost(fwd_time=bad)
    with pytest.raises(ValueError):
        PipeCost(fwd_mem=1.0)
    PipePartition(4, (0.1, 0.2, 0.3, 0.4))
    for plan in ((0.1, 0.2, 0.3), (0.1, 0.2, 0.3, 0.3)):
        with pytest.raises(AssertionError):
            PipePartition(4, plan)
    with pytest.raises(ValueError):
        check_event_type("NOPE")
    with pytest.raises(TypeError):
        event_name("COMM", 0, 0)


def _rows(df):
    return sorted(tuple(r) for r in df.drop("graph_id").collect())


def test_split_and_merge_give_the_whole(spark):
    for schedule, chunks in (("gpipe", 1), ("zb", 2)):
        g = PipelineGraph.build(spark, "g", schedule, 4, 10, chunks, fwd_time=1000, bwd_time=2000, wgt_time=3000)
        g.check()
        low, high = g.filter([0, 1]), g.filter([2, 3])
        whole = merge_graphs("m", [low, high], graph.crossing_edges(g.edges, [0, 1]))
        assert _rows(whole.nodes) == _rows(g.nodes)
        assert _rows(whole.edges) == _rows(g.edges.distinct())
        with pytest.raises(AssertionError):
            merge_graphs("m", [low, low])
        with pytest.raises(TypeError):
            merge_graphs("m", [g, low])
        for bad in ([], [4], [-1]):
            with pytest.raises(AssertionError):
                g.filter(bad)


def test_own_graph(spark):
    g = PipelineGraph.build(spark, "g", "gpipe", 1, 1, fwd_time=5, bwd_time=7)
    g = g.add_node("FWD", 0, 1, 9).add_node("FWD", 0, 1, 11)
    rows = {(r["event_type"], r["microbatch_id"]): (r["event_num"], r["dur"]) for r in g.nodes.collect()}
    assert rows == {("FWD", 0): (1, 5), ("BWD", 0): (2, 7), ("FWD", 1): (4, 11)}
    e = (("FWD", 0, 0, 0), ("FWD", 0, 1, 0))
    assert g.add_edges([e, e]).edges.count() == 2
    with pytest.raises(AssertionError):
        g.add_edges([(("FWD", 0, 0, 0), ("FWD", 9, 9, 0))]).check()
    with pytest.raises(ValueError):
        g.add_node("COMM", 0, 0, 1)
