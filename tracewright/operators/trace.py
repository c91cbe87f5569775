"""Operations on traces: device lists, display strings, appending, equality, meta data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.model import events_equal, info_str


def device_events(trace: DataFrame, device: int, ndevs: int | None = None) -> DataFrame:
    """The events of one device in order; a device outside of the trace is a KeyError."""
    if device < 0 or (ndevs is not None and device >= ndevs):
        raise KeyError(device)
    return trace.where(F.col("dev_id") == device).orderBy("trace_id", "seq")


def device_counts(trace: DataFrame, ndevs: DataFrame) -> DataFrame:
    """(trace_id, dev_id, n_events) of every device, empty ones included; ``ndevs`` has (trace_id, ndevs)."""
    every = ndevs.select("trace_id", F.explode(F.sequence(F.lit(0), F.col("ndevs") - 1)).alias("dev_id"))
    counts = trace.groupBy("trace_id", "dev_id").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, ["trace_id", "dev_id"], "left").select("trace_id", "dev_id", F.coalesce("n", F.lit(0)).alias("n_events"))


def info_strings(trace: DataFrame) -> DataFrame:
    """(trace_id, dev_id, info): the event list of each device in display form."""
    one = F.struct("seq", info_str(F.col("event_num"), F.col("name")).alias("s"))
    listed = F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"])
    return trace.groupBy("trace_id", "dev_id").agg(F.concat(F.lit("["), F.array_join(listed, ", "), F.lit("]")).alias("info"))


def add_events(trace: DataFrame, more: DataFrame) -> DataFrame:
    """``more`` appended to the devices' lists in order of its own ``seq``."""
    last = trace.groupBy("trace_id", "dev_id").agg(F.max("seq").alias("__last"))
    w = Window.partitionBy("trace_id", "dev_id").orderBy("seq", "event_num")
    new = more.join(last, ["trace_id", "dev_id"], "left").withColumn("seq", F.coalesce("__last", F.lit(-1)) + F.row_number().over(w))
    return trace.unionByName(new.drop("__last").select(*trace.columns))


def equal_events(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_num, b_num) of the pairs of equal events; joined on the number, so nothing is paired that cannot be equal."""
    return a.alias("a").join(b.alias("b"), events_equal("a", "b")).select(F.col("a.event_num").alias("a_num"), F.col("b.event_num").alias("b_num"))


def trace_meta(trace: DataFrame) -> DataFrame:
    """(trace_id, ndevs, nstages, nmicrobatches, nchunks) as far as the events tell."""
    top = lambda c: (F.max(c) + 1).cast("int")
    return trace.groupBy("trace_id").agg(
        top("dev_id").alias("ndevs"), top("stage_id").alias("nstages"), top("microbatch_id").alias("nmicrobatches"), top("chunk_id").alias("nchunks")
    )


def empty_trace(spark: SparkSession) -> DataFrame:
    from tracewright.operators.simulate import _TRACE

    return spark.createDataFrame([], _TRACE)


def comm_events(transfers: DataFrame) -> DataFrame:
    """Communication events on the sending device, from (trace_id, seq, event_num, name, ts, dur, src_dev_id, dst_dev_id)."""
    return transfers.select(
        "trace_id", F.col("src_dev_id").alias("dev_id"), "seq", "event_num", F.lit("COMM").alias("event_type"), "name", "ts", "dur", "src_dev_id", "dst_dev_id"
    )


def set_times(trace: DataFrame, ts: Column | None = None, dur: Column | None = None) -> DataFrame:
    """``trace`` with other times; anything but numbers is a TypeError."""
    new = {n: c for n, c in (("ts", ts), ("dur", dur)) if c is not None}
    for name, c in new.items():
        kind = trace.select(c.alias(name)).schema[name].dataType
        if not isinstance(kind, T.NumericType):
            raise TypeError(f"{name} must be a number, not {kind.simpleString()}")
    return trace.withColumns({n: c.cast(trace.schema[n].dataType) for n, c in new.items()})
