"""Profiler documents as traces."""

from __future__ import annotations

import sqlite3
from abc import ABC, abstractmethod
from collections.abc import Iterator, Sequence
from contextlib import closing
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.model import check_event_type
from tracewright.plans.durable import broadcast_if_small, cut_counted

#: Only the fields read; others are skipped by the JSON parser.
DOC_SCHEMA = "distributedInfo struct<world_size: string>, traceEvents array<struct<name: string, tid: string, ts: double, dur: double>>"
# Beginnings of profiler names by event type.  Other types are not in a profile.
PREFIXES = {"FWD": "forward_step", "BWD": "backward_step"}


def classify(name: Column, event_types: Sequence[str]) -> Column:
    """The first requested type whose prefix the name has, else null."""
    out = F.lit(None).cast("string")
    for t in reversed(list(event_types)):
        check_event_type(t)
        if t in PREFIXES:
            out = F.when(F.startswith(name, F.lit(PREFIXES[t])), F.lit(t)).otherwise(out)
    return out


def events_of(docs: DataFrame, event_types: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Events of documents (``distributedInfo``, ``traceEvents`` columns); the id is the place among all raw events.

    An event on a device outside of the world is an error, as is a matched event without a whole ``tid``.
    """
    x = docs.select(*carry, F.col("distributedInfo.world_size").cast("int").alias("ndevs"), F.posexplode("traceEvents").alias("pos", "e"))
    x = x.withColumn("event_type", classify(F.col("e.name"), event_types)).where(F.col("event_type").isNotNull())
    dev = F.col("e.tid").cast("int")
    outside = dev.isNull() | (dev < 0) | (dev >= F.col("ndevs"))
    message = F.concat(F.lit("device outside of the trace: "), F.coalesce(F.col("e.tid"), F.lit("null")))
    dev = F.when(outside, F.raise_error(message).cast("int")).otherwise(dev)
    return x.select(
        *carry, "ndevs", dev.alias("dev_id"), (F.col("pos") + 1).cast("long").alias("event_num"), "event_type",
        F.col("e.name").alias("name"), F.col("e.ts").alias("ts"), F.col("e.dur").alias("dur"), F.col("pos").cast("long").alias("seq"),
    )


class TraceSource(ABC):
    """Reads traces; a subclass names its format."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.outputs: list[DataFrame] = []

    @abstractmethod
    def read(self, spark: SparkSession, event_types: Sequence[str]) -> DataFrame: ...


class ProfilerJson(TraceSource):
    """One JSON document per file, the file being the trace; or with ``lines`` one per line, with a ``trace_id`` in it."""

    def __init__(self, path: str, lines: bool = False) -> None:
        super().__init__(path)
        self.lines = lines

    def read(self, spark: SparkSession, event_types: Sequence[str]) -> DataFrame:
        if self.lines:
            docs = spark.read.schema("trace_id string, " + DOC_SCHEMA).json(self.path)
        else:
            docs = spark.read.schema(DOC_SCHEMA).option("multiLine", True).json(self.path).withColumn("trace_id", F.input_file_name())
        out = events_of(docs, event_types, ["trace_id"])
        self.outputs.append(out)
        return out


class ProfilerTable(TraceSource):
    """A CSV or Parquet export with one row per event: name, tid, ts, dur (and trace_id, seq if it has them).

    Without ``seq`` it is the row's place in its file, however the file is split.
    """

    def read(self, spark: SparkSession, event_types: Sequence[str]) -> DataFrame:
        raw = spark.read.parquet(self.path) if self.path.endswith(".parquet") else spark.read.option("header", True).csv(self.path)
        out = _typed(raw if "seq" in raw.columns else _placed(raw), event_types, self.path)
        self.outputs.append(out)
        return out


def _placed(raw: DataFrame) -> DataFrame:
    """Rows with their place in their file, by the sizes of its splits; the rows themselves are not shuffled."""
    x = raw.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block")).withColumn("__i", F.monotonically_increasing_id())
    splits = x.groupBy("__file", "__block").agg(F.count(F.lit(1)).alias("__n"), F.min("__i").alias("__first"))
    before = F.sum("__n").over(Window.partitionBy("__file").orderBy("__block")) - F.col("__n")
    starts, n = cut_counted(splits.select("__file", "__block", (before - F.col("__first")).alias("__from")))
    return x.join(broadcast_if_small(starts, n), ["__file", "__block"]).withColumn("seq", F.col("__i") + F.col("__from")).drop("__file", "__block", "__i", "__from")


def _typed(raw: DataFrame, event_types: Sequence[str], path: str) -> DataFrame:
    x = raw.withColumn("event_type", classify(F.col("name"), event_types)).where(F.col("event_type").isNotNull())
    trace_id = F.col("trace_id") if "trace_id" in raw.columns else F.lit(path)
    return x.select(
        trace_id.alias("trace_id"), F.col("tid").cast("int").alias("dev_id"), F.col("seq").cast("long").alias("seq"), "event_type", "name",
        F.col("ts").cast("double").alias("ts"), F.col("dur").cast("double").alias("dur"),
    )


class ProfilerSqlite(TraceSource):
    """An SQLite export in a folder that all executors see, read in ranges of row ids.

    ``table`` has columns for name, tid, ts and dur, named by ``columns`` where they differ; ``seq`` is the place by row id.
    """

    def __init__(self, path: str, table: str = "events", columns: dict[str, str] | None = None, rows: int = 1_000_000) -> None:
        super().__init__(path)
        self.table, self.rows = table, rows
        self.columns = {c: c for c in ("name", "tid", "ts", "dur")} | (columns or {})

    def read(self, spark: SparkSession, event_types: Sequence[str]) -> DataFrame:
        file, step = self.path.removeprefix("file://"), self.rows
        quoted = lambda name: '"' + name.replace('"', '""') + '"'
        wanted = ", ".join(quoted(self.columns[c]) for c in ("name", "tid", "ts", "dur"))
        source = f"SELECT rowid, {wanted} FROM {quoted(self.table)} WHERE rowid >= ? AND rowid < ? ORDER BY rowid"
        with closing(_sqlite(file)) as con:
            low, high = con.execute(f"SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM {quoted(self.table)}").fetchone()

        def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with closing(_sqlite(file)) as con:
                for batch in batches:
                    for start in batch["id"].to_pylist():
                        rows = con.execute(source, (start, start + step))
                        while part := rows.fetchmany(50_000):
                            cols = list(zip(*part, strict=True))
                            texts = [pa.array([None if v is None else str(v) for v in c], pa.string()) for c in cols[1:3]]
                            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *texts, *[pa.array([None if v is None else float(v) for v in c], pa.float64()) for c in cols[3:]]], names=["row", "name", "tid", "ts", "dur"])

        starts = spark.range(low, high + 1, step, max(1, -(-(high + 1 - low) // step)))
        raw = starts.mapInArrow(load, "row long, name string, tid string, ts double, dur double")
        out = _typed(raw.withColumn("seq", F.col("row") - F.lit(low)), event_types, self.path)
        self.outputs.append(out)
        return out


def _sqlite(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


class TraceSink(ABC):
    """Writes traces; a subclass names its format."""

    def __init__(self, path: str) -> None:
        self.path = path

    @abstractmethod
    def write(self, trace: DataFrame) -> None: ...


class ProfilerJsonLines(TraceSink):
    """One document per trace and line.  A document holds its whole trace, so traces must fit in a task one by one."""

    def write(self, trace: DataFrame) -> None:
        prefix = F.col("event_type")
        for t, p in PREFIXES.items():
            prefix = F.when(F.col("event_type") == t, F.lit(p)).otherwise(prefix)
        name = F.when(F.startswith(F.col("name"), prefix), F.col("name")).otherwise(F.concat_ws("-", prefix, "name"))
        event = F.struct("seq", "dev_id", name.alias("name"), F.col("dev_id").cast("string").alias("tid"), F.col("ts").cast("double").alias("ts"), F.col("dur").cast("double").alias("dur"))
        listed = F.transform(F.array_sort(F.collect_list(event)), lambda e: F.struct(e["name"].alias("name"), e["tid"].alias("tid"), e["ts"].alias("ts"), e["dur"].alias("dur")))
        docs = trace.groupBy("trace_id").agg(F.struct((F.max("dev_id") + 1).alias("world_size")).alias("distributedInfo"), listed.alias("traceEvents"))
        docs.write.mode("errorifexists").json(self.path)
