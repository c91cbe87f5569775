"""The operators as workflow steps, and simulators as objects."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tracewright.operators import metrics
from tracewright.operators.graph import PipelineGraph, merge_graphs
from tracewright.operators.simulate import simulate, simulate_any
from tracewright.plans.flow import FlowNode
from tracewright.sources import svg
from tracewright.sources.profiler import TraceSource


class Simulator(ABC):
    """Turns a graph into a trace."""

    @abstractmethod
    def run(self, graph: PipelineGraph) -> DataFrame: ...


class PipelineSimulator(Simulator):
    """Pipeline-parallel simulation; ``graph``, ``trace`` and ``perf`` stay readable afterwards."""

    def __init__(self) -> None:
        self.graph: PipelineGraph | None = None
        self.trace: DataFrame | None = None

    def run(self, graph: PipelineGraph) -> DataFrame:
        self.graph = graph
        self.trace = simulate_any(graph.nodes, graph.edges)
        return self.trace

    def perf(self) -> dict[str, Any]:
        """Makespan, busy time and bubble ratio of the last run."""
        if self.graph is None or self.trace is None:
            raise RuntimeError("nothing was simulated yet")
        spark: SparkSession = self.trace.sparkSession
        sizes = spark.createDataFrame([(self.graph.graph_id, self.graph.nstages)], "trace_id string, nstages int")
        row = metrics.bubble(self.trace, sizes).first()
        return row.asDict() if row else {}


def simulator(kind: str) -> Simulator:
    """``pp`` is pipeline parallelism; data and tensor parallelism have no model."""
    if kind == "pp":
        return PipelineSimulator()
    if kind in ("dp", "tp", "dptp"):
        raise NotImplementedError(f"there is no model of {kind} yet")
    raise ValueError(f"unknown simulator {kind!r}")


def read_step(node_id: int, source: TraceSource, spark: SparkSession, event_types: Sequence[str]) -> FlowNode:
    return FlowNode("read", node_id, lambda _: source.read(spark, event_types))


def filter_step(node_id: int, stages: Sequence[int]) -> FlowNode:
    return FlowNode("filter", node_id, lambda graphs: [_graph(g).filter(stages) for g in graphs])


def merge_step(node_id: int, graph_id: str, edges: DataFrame | Sequence[tuple[tuple, tuple]] = ()) -> FlowNode:
    return FlowNode("merge", node_id, lambda graphs: merge_graphs(graph_id, [_graph(g) for g in graphs], edges))


def simulate_step(node_id: int) -> FlowNode:
    return FlowNode("simulate", node_id, lambda graphs: [simulate(_graph(g).nodes, g.edges) for g in graphs])


def draw_step(node_id: int, path: str, title: str = "Title") -> FlowNode:
    return FlowNode("draw", node_id, lambda traces: [svg.draw(t, path, title) for t in traces[:1]])


def _graph(g: Any) -> PipelineGraph:
    if not isinstance(g, PipelineGraph):
        raise TypeError("only pipeline graphs are supported")
    return g
