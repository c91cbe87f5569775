"""Simulation of task graphs into timed traces.

A node becomes ready when all its predecessors were taken; ready nodes are taken first in, first out,
successors of one node in order of event number.  A node without predecessors starts at 0; any other
starts at the later of its predecessors' ends and the end of what its stage took last.

* :func:`simulate` runs one scenario per group in a pandas kernel, linear in nodes and edges; scenarios spread
  over the cluster by ``graph_id``.
* :func:`simulate_configs` serves sweeps: the order in which the queue yields nodes does not depend on
  durations, so it is found once per shape (schedule, sizes) and applied to all scenarios of that shape
  at once, in numpy, without a shuffle.
* :func:`simulate_any` sends a graph too large for one task to :func:`simulate_waves`, all others to the kernel.
* :func:`simulate_waves` states the same as relations (hop depth, rank within a wave,
  longest path) for a single graph too large for one task.

Edges whose ends do not both exist are ignored; nodes on a cycle are missing
from the trace (:func:`unreached` lists them); a null duration counts as 0; repeated nodes and edges count once.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tracewright.model import EDGE_COLS, KEY_COLS, NODE_COLS, TRACE_COLS
from tracewright.operators.graph import clean_edges, clean_nodes, numbered_edges
from tracewright.operators.schedules import graph_edges, graph_nodes
from tracewright.plans.durable import broadcast_if_small, cut, cut_counted, discard

_TRACE = (
    "trace_id string, dev_id int, seq bigint, event_num bigint, event_type string, name string, ts bigint, dur bigint, "
    "stage_id int, microbatch_id int, chunk_id int"
)


def _take_order(nodes: list[int], after: dict[int, list[int]], waiting: dict[int, int]) -> list[int]:
    """Nodes in the order in which the queue yields them."""
    queue = deque(n for n in nodes if not waiting[n])
    order = []
    while queue:
        n = queue.popleft()
        order.append(n)
        for k in after[n]:
            waiting[k] -= 1
            if not waiting[k]:
                queue.append(k)
    return order


def run_schedule(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """The kernel: nodes (event_num, stage_id, dur, ...) and edges (src_num, dst_num) of one scenario, in and timed."""
    nodes = nodes.sort_values("event_num", kind="stable")
    nums = nodes["event_num"].tolist()
    before: dict[int, list[int]] = {n: [] for n in nums}
    after: dict[int, list[int]] = {n: [] for n in nums}
    edges = edges.drop_duplicates(["src_num", "dst_num"]).sort_values(["src_num", "dst_num"])
    for a, b in zip(edges["src_num"].tolist(), edges["dst_num"].tolist(), strict=True):
        after[a].append(b)
        before[b].append(a)
    stage = dict(zip(nums, nodes["stage_id"].tolist(), strict=True))
    dur = dict(zip(nums, nodes["dur"].fillna(0).astype("int64").tolist(), strict=True))
    end: dict[int, int] = {}
    clock: dict[int, int] = {}
    seq: dict[int, int] = {}
    taken: dict[int, int] = {}
    for n in _take_order(nums, after, {n: len(p) for n, p in before.items()}):
        s = stage[n]
        start = max(clock.get(s, 0), *(end[p] for p in before[n])) if before[n] else 0
        end[n] = clock[s] = start + dur[n]
        seq[n] = taken[s] = taken.get(s, -1) + 1
    out = nodes[nodes["event_num"].isin(end)].copy()
    out["ts"] = [end[n] - dur[n] for n in out["event_num"]]
    out["dur"] = [dur[n] for n in out["event_num"]]
    out["seq"] = [seq[n] for n in out["event_num"]]
    return out


def _unique(nodes: pd.DataFrame) -> pd.DataFrame:
    """One node per key: the last added, a known duration before a null one (as :func:`clean_nodes`)."""
    return nodes.sort_values(["event_num", "dur"], kind="stable", na_position="first").drop_duplicates(KEY_COLS, keep="last")


def _numbered(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """Edges between existing nodes, by number (as :func:`numbered_edges`)."""
    number = dict(zip(zip(*(nodes[c].tolist() for c in KEY_COLS), strict=True), nodes["event_num"].tolist(), strict=True))
    ends = [zip(*(edges[c].tolist() for c in EDGE_COLS[i : i + 4]), strict=True) for i in (1, 5)]
    pairs = [(number[a], number[b]) for a, b in zip(*ends, strict=True) if a in number and b in number]
    return pd.DataFrame(pairs, columns=["src_num", "dst_num"])


def simulate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The timed trace of every graph; device = stage, ``seq`` = order of execution on it.

    Nodes and edges are shuffled once, by graph; repeated rows and keys are settled where the graph is simulated.
    """

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = _unique(left)
        out = run_schedule(left, _numbered(left, right))
        return out.assign(trace_id=out["graph_id"], dev_id=out["stage_id"])[TRACE_COLS]

    by_graph = edges.select(F.col("graph_id").alias("of_graph"), *EDGE_COLS[1:])
    return nodes.select(*NODE_COLS).groupBy("graph_id").cogroup(by_graph.groupBy("of_graph")).applyInPandas(kernel, _TRACE)


#: Nodes of one graph that are simulated in one task.
TASK_NODES = 5_000_000


def simulate_any(nodes: DataFrame, edges: DataFrame, task_nodes: int = TASK_NODES) -> DataFrame:
    """The trace of every graph: in the kernel where it fits a task, by waves over the cluster where it has more nodes."""
    sizes = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    large, n = cut_counted(sizes.where(F.col("n") > task_nodes).select("graph_id"))
    if not n:
        return simulate(nodes, edges)
    side = broadcast_if_small(large, n)
    apart = [x.join(side, "graph_id", how) for how in ("left_anti", "left_semi") for x in (nodes, edges)]
    return simulate(*apart[:2]).unionByName(simulate_waves(*apart[2:]))


def unreached(nodes: DataFrame, trace: DataFrame) -> DataFrame:
    """Nodes that the simulation never took (on or behind a cycle)."""
    return clean_nodes(nodes).join(trace.select(F.col("trace_id").alias("graph_id"), "event_num"), ["graph_id", "event_num"], "left_anti")


_SHAPE = ["schedule", "nstages", "nmicrobatches", "nchunks", "eager"]
#: Nodes of all shapes of a sweep that the driver may hold; with more, every scenario is simulated by itself.
MAX_SHAPE_NODES = 500_000
#: Trace rows made at once.
_ROWS = 1_000_000


def _shapes(configs: DataFrame) -> DataFrame:
    """The take order of every distinct shape: position, node, positions of predecessors."""
    shapes = configs.select(*_SHAPE).distinct()
    as_config = shapes.withColumns({"graph_id": F.to_json(F.struct(*_SHAPE)), **{f"{k}_time": F.lit(0).cast("long") for k in ("fwd", "bwd", "wgt")}})
    nodes = graph_nodes(as_config)
    pairs = numbered_edges(nodes, clean_edges(graph_edges(as_config))).select(F.col("graph_id").alias("of_graph"), "src_num", "dst_num")

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.set_index("event_num").sort_index()
        before: dict[int, list[int]] = {n: [] for n in left.index}
        after: dict[int, list[int]] = {n: [] for n in left.index}
        for a, b in right[["src_num", "dst_num"]].sort_values(["src_num", "dst_num"]).itertuples(index=False):
            before[b].append(a)
            after[a].append(b)
        order = _take_order(list(left.index), after, {n: len(p) for n, p in before.items()})
        place = {n: i for i, n in enumerate(order)}
        out = left.loc[order].reset_index()
        return out.assign(place=range(len(order)), before=[[place[p] for p in before[n]] for n in order])[
            ["graph_id", "place", "event_num", "event_type", "stage_id", "microbatch_id", "chunk_id", "name", "before"]
        ]

    schema = "graph_id string, place int, event_num bigint, event_type string, stage_id int, microbatch_id int, chunk_id int, name string, before array<int>"
    return nodes.groupBy("graph_id").cogroup(pairs.groupBy("of_graph")).applyInPandas(kernel, schema)


def _timed(shape: list, cost: np.ndarray) -> np.ndarray:
    """Ends of all nodes (rows, in take order) in all scenarios (columns); ``cost`` has a row per event type."""
    end = np.zeros((len(shape), cost.shape[1]), np.int64)
    last: dict[int, int] = {}
    for i, (kind, stage, before) in enumerate(shape):
        if before:
            start = end[before].max(axis=0)
            if stage in last:
                start = np.maximum(start, end[last[stage]])
            end[i] = start + cost[kind]
        else:
            end[i] = cost[kind]
        last[stage] = i
    return end


def simulate_configs(configs: DataFrame, max_shape_nodes: int = MAX_SHAPE_NODES) -> DataFrame:
    """The timed traces of configurations, equal to simulating their nodes and edges."""
    found = _shapes(configs).limit(max_shape_nodes + 1).collect()
    if len(found) > max_shape_nodes:
        return simulate(graph_nodes(configs), graph_edges(configs))
    shapes: dict[str, list] = {}
    for r in sorted(found, key=lambda r: (r["graph_id"], r["place"])):
        shapes.setdefault(r["graph_id"], []).append(tuple(r)[2:])
    known = configs.sparkSession.sparkContext.broadcast(shapes)
    times = [F.coalesce(f"{k}_time", F.lit(0)).cast("long").alias(k) for k in ("fwd", "bwd", "wgt")]
    rows = configs.select("graph_id", F.to_json(F.struct(*_SHAPE)).alias("shape"), *times)
    schema = StructType.fromDDL(_TRACE)
    arrow = to_arrow_schema(schema)
    kinds = {"FWD": 0, "BWD": 1, "WGT": 2}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_shape: dict[str, list[int]] = {}
            for i, s in enumerate(batch["shape"].to_pylist()):
                by_shape.setdefault(s, []).append(i)
            for s, every in by_shape.items():
                shape = known.value.get(s)
                if not shape:
                    continue
                n = len(shape)
                seen: dict[int, int] = {}
                seq = []
                for x in shape:
                    seq.append(seen.setdefault(x[2], 0))
                    seen[x[2]] += 1
                for k in range(0, len(every), max(1, _ROWS // n)):
                    at = pa.array(every[k : k + max(1, _ROWS // n)])
                    cost = np.array([batch[c].take(at).to_numpy() for c in ("fwd", "bwd", "wgt")])
                    m = cost.shape[1]
                    end = _timed([(kinds[x[1]], x[2], x[6]) for x in shape], cost)
                    dur = cost[[kinds[x[1]] for x in shape]]
                    column = lambda v, kind, m=m: pa.array(np.tile(np.array(v, kind), m))
                    word = lambda j, m=m: pa.DictionaryArray.from_arrays(pa.array(np.tile(np.arange(n, dtype=np.int32), m)), pa.array([x[j] for x in shape])).cast(pa.string())
                    stage = column([x[2] for x in shape], np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [batch["graph_id"].take(at).take(pa.array(np.repeat(np.arange(m), n))), stage, column(seq, np.int64), column([x[0] for x in shape], np.int64),
                         word(1), word(5), pa.array((end - dur).T.ravel()), pa.array(dur.T.ravel()), stage,
                         column([x[3] for x in shape], np.int32), column([x[4] for x in shape], np.int32)],
                        schema=arrow,
                    )

    return rows.mapInArrow(run, schema)


def simulate_waves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The same trace by relational waves: one bounded-lineage step per hop of the longest path.

    A wave holds the nodes whose last predecessor was in the wave before; within it they are taken by the rank of that
    predecessor and their number.  Ends follow from window sums: on one stage the i-th node of a wave ends at
    S_i + max over j <= i of (ready_j - S_(j-1)), with S the running sum of durations.
    """
    key, lane = ["graph_id", "event_num"], ["graph_id", "stage_id"]
    nodes = cut(clean_nodes(nodes).drop("ts").withColumn("dur", F.coalesce("dur", F.lit(0))))
    pairs = cut(numbered_edges(nodes, clean_edges(edges)))
    need = pairs.groupBy("graph_id", F.col("dst_num").alias("event_num")).agg(F.count(F.lit(1)).alias("need"))
    facts = nodes.select(*key, "stage_id", "dur")
    rank = F.row_number().over(Window.partitionBy("graph_id").orderBy("last", "event_num")).cast("long")
    on_stage = Window.partitionBy(*lane).orderBy("rank")
    zero = F.lit(0).cast("long")
    head = facts.join(need, key, "left_anti").select(*key, "stage_id", "dur", zero.alias("last")).withColumn("rank", rank)
    wave, n = cut_counted(head.select(*key, "stage_id", "rank", F.col("dur").alias("end"), F.lit(0).alias("depth")))
    state = cut(need.join(facts, key).select(*key, "stage_id", "dur", "need", zero.alias("ready")))
    clocks = None
    waves = [wave]
    while n:  # at most one wave per node of the longest path
        now = wave.groupBy(*lane).agg(F.max_by("end", "rank").alias("new"))
        if clocks is not None:
            now = clocks.join(now, lane, "full").select(*lane, F.coalesce("new", "clock").alias("clock"))
        else:
            now = now.withColumnRenamed("new", "clock")
        old_clocks, clocks = clocks, cut(now)
        hit = (
            wave.select("graph_id", F.col("event_num").alias("src_num"), "rank", "end")
            .join(pairs, ["graph_id", "src_num"])
            .groupBy("graph_id", F.col("dst_num").alias("event_num"))
            .agg(F.count(F.lit(1)).alias("met"), F.max("rank").alias("last"), F.max("end").alias("from"))
        )
        old_state, state = state, cut(
            state.where("need > 0").drop("last").join(hit, key, "left").select(
                *key, "stage_id", "dur", (F.col("need") - F.coalesce("met", zero)).alias("need"), F.greatest("ready", F.coalesce("from", zero)).alias("ready"), "last"
            )
        )
        due = state.where("need = 0").withColumn("rank", rank).join(clocks, lane, "left")
        ready = F.greatest("ready", F.coalesce("clock", zero))
        due = due.withColumn("sum", F.sum("dur").over(on_stage)).withColumn("free", F.max(ready - F.col("sum") + F.col("dur")).over(on_stage))
        wave, n = cut_counted(due.select(*key, "stage_id", "rank", (F.col("sum") + F.col("free")).alias("end"), F.lit(len(waves)).alias("depth")))
        waves.append(wave)
        for gone in (old_clocks, old_state):
            if gone is not None:
                discard(gone)
    taken = waves[0]
    for w in waves[1:]:
        taken = taken.unionByName(w)
    seq = (F.row_number().over(Window.partitionBy(*lane).orderBy("depth", "rank")) - 1).cast("long")
    return nodes.join(taken.drop("stage_id"), key).withColumn("seq", seq).select(
        F.col("graph_id").alias("trace_id"), F.col("stage_id").alias("dev_id"), "seq", "event_num", "event_type", "name",
        (F.col("end") - F.col("dur")).alias("ts"), "dur", "stage_id", "microbatch_id", "chunk_id",
    )
