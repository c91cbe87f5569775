"""Performance figures of a trace: makespan, busy time, bubbles, idle gaps, phases, critical events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _end():
    return F.col("ts") + F.col("dur")



def makespan(trace: DataFrame) -> DataFrame:
    return trace.groupBy("trace_id").agg(F.greatest(F.lit(0).cast("long"), F.max(_end())).alias("makespan"))


def stage_busy(trace: DataFrame) -> DataFrame:
    return trace.groupBy("trace_id", "dev_id").agg(F.sum("dur").alias("busy"), F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("first_ts"), F.max(_end()).alias("last_end"))


def bubble(trace: DataFrame, sizes: DataFrame) -> DataFrame:
    """1 - busy / (stages * makespan); ``sizes`` has (trace_id, nstages).  Null where nothing took time."""
    total = trace.groupBy("trace_id").agg(F.sum("dur").alias("busy"), F.max(_end()).alias("makespan"))
    room = F.col("nstages").cast("long") * F.col("makespan")
    return total.join(sizes, "trace_id").select(
        "trace_id", "makespan", "busy", F.when(room > 0, 1 - F.col("busy") / room).alias("bubble_ratio")
    )


def idle_gaps(trace: DataFrame) -> DataFrame:
    """Waits on a device between one event's end and the next one's start, in order of execution."""
    w = Window.partitionBy("trace_id", "dev_id").orderBy("seq")
    x = trace.withColumn("gap_start", F.coalesce(F.lag(_end()).over(w), F.lit(0)))
    return x.where(F.col("ts") > F.col("gap_start")).select("trace_id", "dev_id", "seq", "gap_start", F.col("ts").alias("gap_end"), (F.col("ts") - F.col("gap_start")).alias("idle"))


def phase_times(trace: DataFrame) -> DataFrame:
    """Total, first start and last end of each event type."""
    return trace.groupBy("trace_id", "event_type").agg(F.sum("dur").alias("total"), F.min("ts").alias("first_ts"), F.max(_end()).alias("last_end"))


def critical_path(trace: DataFrame, edges: DataFrame) -> DataFrame:
    """(trace_id, step, event_num, ts, dur): back from the event that ends last to one that waited for nothing.

    An event waited for a predecessor, or for what its device ran before, that ended when it started; of several the one
    with the smallest number is taken.  ``edges`` are (graph_id, src_num, dst_num).
    """
    links = edges.select(F.col("graph_id").alias("of_graph"), "src_num", "dst_num")

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["dev_id", "seq"])
        before: dict[int, set[int]] = {}
        for a, b in zip(right["src_num"].tolist(), right["dst_num"].tolist(), strict=True):
            before.setdefault(b, set()).add(a)
        for _, lane in left.groupby("dev_id"):
            nums = lane["event_num"].tolist()
            for a, b in zip(nums, nums[1:], strict=False):
                before.setdefault(b, set()).add(a)
        start = dict(zip(left["event_num"].tolist(), left["ts"].tolist(), strict=True))
        took = dict(zip(left["event_num"].tolist(), left["dur"].tolist(), strict=True))
        path, at, seen = [], min(start, key=lambda n: (-(start[n] + took[n]), n), default=None), set()
        while at is not None and at not in seen:
            path.append(at)
            seen.add(at)
            at = min((p for p in before.get(at, ()) if p in start and start[at] > 0 and start[p] + took[p] == start[at]), default=None)
        path.reverse()
        name = left["trace_id"].iloc[0] if len(left) else ""
        return pd.DataFrame({"trace_id": [name] * len(path), "step": range(len(path)), "event_num": path, "ts": [start[n] for n in path], "dur": [took[n] for n in path]})

    schema = "trace_id string, step bigint, event_num bigint, ts bigint, dur bigint"
    return trace.groupBy("trace_id").cogroup(links.groupBy("of_graph")).applyInPandas(kernel, schema)
