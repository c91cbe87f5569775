"""Domains, schemas and checked configurations of the pipeline-trace data model."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Event types with their codes, and the letters of event names.
EVENT_TYPES = {"OPRT": 0, "COMM": 1, "FWD": 2, "BWD": 3, "WGT": 4}
LETTERS = {"FWD": "F", "BWD": "B", "WGT": "W"}
#: Timestamp of an event that was not simulated yet.
NO_TIMESTAMP = -1
SCHEDULES = ("gpipe", "pipedream", "interleaved", "zb", "zbv")
#: Schedules that split the backward pass and so have WGT events.
SPLIT_BACKWARD = ("zb", "zbv")
#: The kind of graphs and partitions that are given by hand.
CUSTOM = "custom"
PARTITION_KINDS = ("uniform", CUSTOM)

CONFIG_SCHEMA = T.StructType(
    [T.StructField("graph_id", T.StringType()), T.StructField("schedule", T.StringType())]
    + [T.StructField(c, T.IntegerType()) for c in ("nstages", "nmicrobatches", "nchunks")]
    + [T.StructField(c, T.LongType()) for c in ("fwd_time", "bwd_time", "wgt_time")]
    + [T.StructField("eager", T.BooleanType())]
)
NODE_COLS = ["graph_id", "event_num", "event_type", "stage_id", "microbatch_id", "chunk_id", "name", "ts", "dur"]
KEY_COLS = ["event_type", "stage_id", "microbatch_id", "chunk_id"]
EDGE_COLS = ["graph_id", "src_type", "src_stage", "src_mb", "src_chk", "dst_type", "dst_stage", "dst_mb", "dst_chk"]
TRACE_COLS = ["trace_id", "dev_id", "seq", "event_num", "event_type", "name", "ts", "dur", "stage_id", "microbatch_id", "chunk_id"]


def check_event_type(name: str, allowed: tuple[str, ...] = tuple(EVENT_TYPES)) -> str:
    if name not in allowed:
        raise ValueError(f"event type {name!r} is none of {', '.join(allowed)}")
    return name


def event_name(event_type: str, microbatch: int, chunk: int) -> str:
    """``F:3-0`` and the like."""
    if event_type not in LETTERS:
        raise TypeError(f"events of type {event_type} have no schedule name")
    return f"{LETTERS[event_type]}:{microbatch}-{chunk}"


def event_name_col(event_type: Column, microbatch: Column, chunk: Column) -> Column:
    letter = F.when(event_type == "FWD", "F").when(event_type == "BWD", "B").when(event_type == "WGT", "W")
    return F.concat(letter, F.lit(":"), microbatch.cast("string"), F.lit("-"), chunk.cast("string"))


def info_str(event_num: Column, name: Column) -> Column:
    """The display form of an event."""
    return F.format_string("<Event %d:%s>", event_num, name)


def events_equal(a: str, b: str) -> Column:
    """Null-safe equality on the base fields of two aliased event relations."""
    same = [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in ("event_num", "event_type", "name", "ts", "dur")]
    out = same[0]
    for s in same[1:]:
        out = out & s
    return out


@dataclass(frozen=True)
class PipeCost:
    """Cost of one step of each kind; times are exact whole numbers, memory deltas sum to zero."""

    fwd_time: int = 1
    bwd_time: int = 1
    wgt_time: int = 1
    comm_time: int = 1
    fwd_mem: float = 2.0
    bwd_mem: float = -1.0
    wgt_mem: float = -1.0

    def __post_init__(self) -> None:
        for f in fields(self):
            if f.name.endswith("_time") and type(getattr(self, f.name)) is not int:
                raise TypeError(f"{f.name} must be a whole number")
        if self.fwd_mem + self.bwd_mem + self.wgt_mem != 0:
            raise ValueError("memory taken by a step must be given back")


@dataclass(frozen=True)
class PipePartition:
    """Share of the layers that each stage holds."""

    nstages: int
    ratios: tuple[float, ...]

    def __post_init__(self) -> None:
        if len(self.ratios) != self.nstages:
            raise AssertionError("one ratio per stage is needed")
        if sum(self.ratios) != 1:
            raise AssertionError("ratios must sum to 1")


def event_type_is_known(event_type: Column) -> Column:
    """The domain check of :func:`check_event_type` for a column."""
    return F.coalesce(event_type.isin(*EVENT_TYPES), F.lit(False))


def cost_is_valid(fwd: Column, bwd: Column, wgt: Column, memory: tuple[Column, Column, Column] | None = None) -> Column:
    """The checks of :class:`PipeCost`: times are whole numbers, and the memory that steps take is given back."""
    whole = lambda c: c.isNotNull() & F.coalesce(c == F.floor(c), F.lit(False))
    ok = whole(fwd) & whole(bwd) & whole(wgt)
    return ok if memory is None else ok & F.coalesce(memory[0] + memory[1] + memory[2] == 0, F.lit(False))


def partition_is_valid(nstages: Column, ratios: Column, tolerance: float = 1e-9) -> Column:
    total = F.aggregate(ratios, F.lit(0.0), lambda a, x: a + x)
    return (F.size(ratios) == nstages) & (F.abs(total - 1) <= tolerance)
