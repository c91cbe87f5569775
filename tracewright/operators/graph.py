"""Composing task graphs: checks, degrees, filters, merges and cut edges."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.model import CUSTOM, EDGE_COLS, KEY_COLS, NODE_COLS, check_event_type
from tracewright.operators.schedules import config_frame, graph_edges, graph_nodes

_SIDE = {"src": ["src_type", "src_stage", "src_mb", "src_chk"], "dst": ["dst_type", "dst_stage", "dst_mb", "dst_chk"]}


def clean_nodes(nodes: DataFrame) -> DataFrame:
    """One row per key: the last added (largest number) wins, a known duration before a null one."""
    w = Window.partitionBy("graph_id", *KEY_COLS).orderBy(F.col("event_num").desc(), F.col("dur").desc_nulls_last())
    return nodes.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r").select(*NODE_COLS)


def clean_edges(edges: DataFrame) -> DataFrame:
    """Edges are a set."""
    return edges.select(*EDGE_COLS).dropDuplicates()


def _endpoint(edges: DataFrame, side: str) -> DataFrame:
    return edges.select("graph_id", *[F.col(c).alias(k) for c, k in zip(_SIDE[side], KEY_COLS, strict=True)], *[F.col(c) for c in EDGE_COLS[1:]])


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of which an end has no node; a sound graph has none."""
    keys = nodes.select("graph_id", *KEY_COLS).dropDuplicates()
    missing = [_endpoint(edges, s).join(keys, ["graph_id", *KEY_COLS], "left_anti").select(*EDGE_COLS) for s in ("src", "dst")]
    return missing[0].unionByName(missing[1]).dropDuplicates()


def numbered_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, src_num, dst_num) of the edges whose ends both exist."""
    keys = nodes.select("graph_id", *KEY_COLS, "event_num")
    out = edges
    for side in ("src", "dst"):
        k = keys.select("graph_id", *[F.col(c).alias(n) for c, n in zip(KEY_COLS, _SIDE[side], strict=True)], F.col("event_num").alias(f"{side}_num"))
        out = out.join(k, ["graph_id", *_SIDE[side]])
    return out.select("graph_id", "src_num", "dst_num")


def in_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, event_num, in_degree) of every node."""
    counts = numbered_edges(nodes, edges).groupBy("graph_id", F.col("dst_num").alias("event_num")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.select("graph_id", "event_num").join(counts, ["graph_id", "event_num"], "left").select(
        "graph_id", "event_num", F.coalesce("n", F.lit(0)).cast("long").alias("in_degree")
    )


def sources(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without incoming edges."""
    to = _endpoint(edges, "dst").select("graph_id", *KEY_COLS).dropDuplicates()
    return nodes.join(to, ["graph_id", *KEY_COLS], "left_anti").select(*NODE_COLS)


def filter_nodes(nodes: DataFrame, stages: Sequence[int]) -> DataFrame:
    return nodes.where(F.col("stage_id").isin(*stages))


def filter_edges(edges: DataFrame, stages: Sequence[int]) -> DataFrame:
    """The stage is part of an edge's key, so the induced subgraph needs no join."""
    return edges.where(F.col("src_stage").isin(*stages) & F.col("dst_stage").isin(*stages))


def crossing_edges(edges: DataFrame, stages: Sequence[int]) -> DataFrame:
    """Edges of the whole graph that a split at ``stages`` cuts."""
    return edges.where(F.col("src_stage").isin(*stages) != F.col("dst_stage").isin(*stages))


def cut_edges(configs: DataFrame, cut: int) -> DataFrame:
    """Data edges over the border between stages ``cut - 1`` and ``cut``, for every microbatch and chunk.

    Forwards run down and backwards up; odd chunks of the V shape the other way round.  The plain zero-bubble
    shape also has its wraps between last and first stage.
    """
    x = configs.where((F.col("nstages") > cut) & (F.lit(cut) > 0))
    x = x.withColumn("m", F.explode(F.sequence(F.lit(0), F.col("nmicrobatches") - 1))).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("nchunks") - 1)))
    low, high, end = F.lit(cut - 1), F.lit(cut), F.col("nstages") - 1
    turned = (F.col("schedule") == "zbv") & (F.col("c") % 2 == 1)
    row = lambda t, a, b, c1, c2: F.struct(F.lit(t).alias("t"), a.cast("int").alias("a"), b.cast("int").alias("b"), c1.cast("int").alias("x"), c2.cast("int").alias("y"))
    c = F.col("c")
    wrap = F.col("schedule") == "zb"
    edges = F.array(
        F.when(turned, row("FWD", high, low, c, c)).otherwise(row("FWD", low, high, c, c)),
        F.when(turned, row("BWD", low, high, c, c)).otherwise(row("BWD", high, low, c, c)),
        F.when(wrap & (c > 0), row("FWD", end, F.lit(0), c - 1, c)),
        F.when(wrap & (c > 0), row("BWD", F.lit(0), end, c, c - 1)),
    )
    e = x.select("graph_id", "m", F.explode(edges).alias("e")).where(F.col("e").isNotNull())
    return e.select(
        "graph_id", F.col("e.t").alias("src_type"), F.col("e.a").alias("src_stage"), F.col("m").alias("src_mb"), F.col("e.x").alias("src_chk"),
        F.col("e.t").alias("dst_type"), F.col("e.b").alias("dst_stage"), F.col("m").alias("dst_mb"), F.col("e.y").alias("dst_chk"),
    )


@dataclass(frozen=True)
class PipelineGraph:
    """Task graphs: nodes and edges as lazy tables.  One graph has its id and sizes here; of many graphs these are None and the ids in the tables tell them apart."""

    graph_id: str | None
    schedule: str
    nstages: int | None
    nmicrobatches: int | None
    nchunks: int | None
    nodes: DataFrame
    edges: DataFrame
    part: bool = False

    @classmethod
    def build(cls, spark: SparkSession, graph_id: str, schedule: str, nstages: int, nmicrobatches: int, nchunks: int = 1, *,
              fwd_time: int, bwd_time: int, wgt_time: int = 1, eager: bool = False) -> PipelineGraph:
        row = {"graph_id": graph_id, "schedule": schedule, "nstages": nstages, "nmicrobatches": nmicrobatches, "nchunks": nchunks,
               "fwd_time": fwd_time, "bwd_time": bwd_time, "wgt_time": wgt_time, "eager": eager}
        configs = config_frame(spark, [row])
        return cls(graph_id, schedule, nstages, nmicrobatches, nchunks, graph_nodes(configs), graph_edges(configs))

    @classmethod
    def of(cls, configs: DataFrame, schedule: str) -> PipelineGraph:
        """The graphs of all configurations of one schedule."""
        own = configs.where(F.col("schedule") == schedule)
        return cls(None, schedule, None, None, None, graph_nodes(own), graph_edges(own, [schedule]))

    @classmethod
    def custom(cls, nodes: DataFrame, edges: DataFrame) -> PipelineGraph:
        """Graphs of no known schedule, by their own nodes and edges."""
        return cls(None, CUSTOM, None, None, None, clean_nodes(nodes), clean_edges(edges))

    @property
    def event_types(self) -> tuple[str, ...]:
        return ("FWD", "BWD", "WGT") if self.schedule in ("zb", "zbv") else ("FWD", "BWD")

    def check(self) -> None:
        if dangling_edges(self.nodes, self.edges).limit(1).count():
            raise AssertionError("an edge has no node at one of its ends")

    def add_node(self, event_type: str, stage: int, microbatch: int, duration: int, chunk: int = 0) -> PipelineGraph:
        """The graph with one more node; a node of the same key is replaced, the number moves on."""
        check_event_type(event_type, ("FWD", "BWD", "WGT"))
        if self.graph_id is None:  # one node more in each graph
            last = self.nodes.groupBy("graph_id").agg(F.max("event_num").alias("n"))
        else:
            last = self.nodes.agg(F.coalesce(F.max("event_num"), F.lit(0)).alias("n")).withColumn("graph_id", F.lit(self.graph_id))
        new = last.select(
            "graph_id", (F.col("n") + 1).alias("event_num"), F.lit(event_type).alias("event_type"),
            F.lit(stage).alias("stage_id"), F.lit(microbatch).alias("microbatch_id"), F.lit(chunk).alias("chunk_id"),
            F.lit(f"{event_type[0]}:{microbatch}-{chunk}").alias("name"), F.lit(-1).cast("long").alias("ts"), F.lit(duration).cast("long").alias("dur"),
        )
        return replace(self, nodes=clean_nodes(self.nodes.unionByName(new)))

    def add_edges(self, edges: DataFrame | Sequence[tuple[tuple, tuple]]) -> PipelineGraph:
        """The graph with more edges, given as a table or as pairs of (type, stage, microbatch, chunk)."""
        if not isinstance(edges, DataFrame):
            if self.graph_id is None:
                raise TypeError("edges of many graphs must be given as a table")
            schema = ", ".join(f"{c} {'string' if c in ('graph_id', 'src_type', 'dst_type') else 'int'}" for c in EDGE_COLS)
            edges = self.nodes.sparkSession.createDataFrame([(self.graph_id, *a, *b) for a, b in edges], schema)
        return replace(self, edges=clean_edges(self.edges.unionByName(edges.select(*EDGE_COLS))))

    def filter(self, stages: Sequence[int]) -> PipelineGraph:
        """The subgraph of some stages; sizes and event numbers stay those of the whole."""
        if not stages or any(s < 0 or (self.nstages is not None and s >= self.nstages) for s in stages):
            raise AssertionError("stages must be given and lie in the graph")
        return replace(self, nodes=filter_nodes(self.nodes, stages), edges=filter_edges(self.edges, stages), part=True)


def merge_graphs(graph_id: str | None, graphs: Sequence[PipelineGraph], edges: DataFrame | Sequence[tuple[tuple, tuple]] = ()) -> PipelineGraph:
    """Disjoint parts of equal shape as one graph, with further edges between them; without ``graph_id``, those of each id as one."""
    if not graphs:
        raise AssertionError("nothing to merge")
    if not all(g.part for g in graphs):
        raise TypeError("only filtered or merged graphs can be merged")
    first = graphs[0]
    if any((g.nstages, g.nmicrobatches, g.nchunks, g.event_types, g.schedule) != (first.nstages, first.nmicrobatches, first.nchunks, first.event_types, first.schedule) for g in graphs):
        raise AssertionError("the graphs differ in shape")
    own = lambda df: df if graph_id is None else df.withColumn("graph_id", F.lit(graph_id))
    nodes = reduce(DataFrame.unionByName, [own(g.nodes) for g in graphs])
    if nodes.groupBy("graph_id", *KEY_COLS).count().where("count > 1").limit(1).count():
        raise AssertionError("a node is in two of the graphs")
    out = replace(first, graph_id=graph_id, nodes=nodes, edges=clean_edges(reduce(DataFrame.unionByName, [own(g.edges) for g in graphs])), part=True)
    if isinstance(edges, DataFrame):
        return out.add_edges(own(edges))
    return out.add_edges(edges) if edges else out
