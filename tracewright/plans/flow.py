"""Workflows: a directed graph of steps from lazy tables to lazy tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

Step = Callable[[list[Any]], Any]


class FlowNode:
    """A named step.  Subclass it and override :meth:`run`, or pass a function of the inputs."""

    def __init__(self, name: str, node_id: int, step: Step | None = None, *, needs: T.StructType | None = None) -> None:
        self.name, self.node_id, self.step, self.needs = name, node_id, step, needs
        self.inputs: list[Any] = []
        self.outputs: list[Any] = []

    def run(self) -> list[Any]:
        out = self.step(self.inputs) if self.step else list(self.inputs)
        return list(out) if isinstance(out, (list, tuple)) else [out]

    def __str__(self) -> str:
        return f"FlowNode({self.node_id}: {self.name})"


class FlowGraph:
    """Nodes by id and their successors in order of insertion."""

    def __init__(self) -> None:
        self.nodes: dict[int, FlowNode] = {}
        self.after: dict[int, list[int]] = {}

    def add_node(self, node: FlowNode) -> FlowNode:
        if node.node_id in self.nodes:
            raise ValueError(f"two nodes have the id {node.node_id}")
        self.nodes[node.node_id] = node
        self.after[node.node_id] = []
        return node

    def add_edge(self, src: int, dst: int) -> None:
        for i in (src, dst):
            self.get_node(i)
        self.after[src].append(dst)

    def get_node(self, node_id: int) -> FlowNode:
        return self.nodes[node_id]

    def next_nodes(self, node_id: int) -> list[FlowNode]:
        return [self.nodes[i] for i in self.after[node_id]]

    def order(self) -> list[int]:
        """Ids in topological order; a cycle is an error."""
        need = dict.fromkeys(self.nodes, 0)
        for to in self.after.values():
            for i in to:
                need[i] += 1
        ready = [i for i, n in need.items() if not n]
        out = []
        while ready:
            i = ready.pop(0)
            out.append(i)
            for k in self.after[i]:
                need[k] -= 1
                if not need[k]:
                    ready.append(k)
        if len(out) < len(self.nodes):
            raise ValueError("the workflow has a cycle")
        return out

    def check(self, node_id: int) -> None:
        """Inputs of a node that are tables must have the columns and types it needs."""
        node = self.get_node(node_id)
        if node.needs is None:
            return
        for table in node.inputs:
            if isinstance(table, DataFrame):
                have = {f.name: f.dataType for f in table.schema.fields}
                for f in node.needs.fields:
                    if have.get(f.name) != f.dataType:
                        raise TypeError(f"{node}: column {f.name} should be {f.dataType.simpleString()}")

    def run(self, inputs: Sequence[Any] = ()) -> dict[int, list[Any]]:
        """Run every node once its inputs are there; tables stay lazy, so one action at a sink runs one plan."""
        fed: dict[int, list[Any]] = {i: [] for i in self.nodes}
        has_before = {k for to in self.after.values() for k in to}
        for i in self.order():
            node = self.nodes[i]
            given = fed[i] if i in has_before else [*node.inputs, *inputs]
            node.inputs = list(given)
            self.check(i)
            node.outputs = node.run()
            for k in self.after[i]:
                fed[k] += node.outputs
        return {i: n.outputs for i, n in self.nodes.items()}
