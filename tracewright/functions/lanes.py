"""Column expressions shared by the trace operators: lanes, ops, valid readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest reading, in microseconds, that counts as valid.
MAX_VALID_DUR = 10_000_000.0


def lane_tid(tid: Column) -> Column:
    """The whole number a ``tid`` text holds, blanks around it dropped; null if it holds none."""
    return F.regexp_extract(tid, r"^\s*([+-]?[0-9]+)\s*$", 1).try_cast("int")


def op_name(name: Column) -> Column:
    """``name`` trimmed, in lower case, up to its first ``-``; null stays null."""
    return F.substring_index(F.lower(F.regexp_replace(name, r"^\s+|\s+$", "")), "-", 1)


def is_valid(ts: Column, dur: Column) -> Column:
    """Valid reading: both present and 0 < dur <= 10 s.  NaN and infinity fail."""
    return ts.isNotNull() & ~F.isnan(ts) & dur.isNotNull() & (dur > 0) & (dur <= MAX_VALID_DUR)


def with_lane(events: DataFrame) -> DataFrame:
    """Events in a lane, ``tid`` replaced by its whole number and ``op`` added."""
    return (
        events.withColumns({"tid": lane_tid(F.col("tid")), "op": op_name(F.col("name"))})
        .where(F.col("tid").isNotNull() & F.col("trace_id").isNotNull())
    )


def valid_readings(events: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """(trace_id, tid, op, event_id, ts, dur, more...) of the valid readings, redelivered rows still in."""
    return (
        with_lane(events)
        .where(is_valid(F.col("ts"), F.col("dur")))
        .select("trace_id", "tid", "op", "event_id", "ts", "dur", *more)
    )
