"""Gantt layout of traces: scale, bars, colours, legend; all as columns, many traces at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the drawing.
SPAN, BORDER, TAIL, FONT = 20, 1, 50, 20
TITLE_WIDTH, TITLE_HEIGHT, UNIT = 120, 120, 2000.0
COLORS = {"FWD": (57, 122, 242), "BWD": (62, 181, 191), "WGT": (41, 137, 64), "COMM": (255, 217, 102), "OPRT": (255, 217, 102)}
LIGHTEN = 70


def summary(trace: DataFrame) -> DataFrame:
    """One row per trace: extent, scale and sizes of the canvas.

    The scale is null where an event has no name or takes no time; such a trace cannot be drawn.
    """
    chunk = F.coalesce(F.col("chunk_id"), F.lit(0))
    per_name = F.when(F.length("name") > 0, F.col("dur") / (F.length("name") * FONT * 0.3)).otherwise(0.0)
    x = trace.groupBy("trace_id").agg(
        F.countDistinct("dev_id").alias("n_rows"),
        F.min("ts").cast("double").alias("first_time"),
        F.greatest(F.lit(0.0), F.max(F.col("ts") + F.col("dur")).cast("double")).alias("last_time"),
        F.greatest(F.lit(1), F.max(chunk)).alias("max_chunk"),
        F.least(F.lit(UNIT), F.min(per_name)).alias("time_per_unit"),
    )
    unit = F.when(F.col("time_per_unit") > 0, F.col("time_per_unit"))
    x = x.withColumn("data_width", F.floor((F.col("last_time") - F.col("first_time") + unit - 1) / unit) + TAIL)
    x = x.withColumn("data_height", (F.lit(SPAN) * F.col("n_rows") + BORDER * (F.col("n_rows") + 1)).cast("long"))
    info = SPAN + int(SPAN * 1.6) + 3 * BORDER
    return x.withColumn("canvas_width", F.col("data_width") + TITLE_WIDTH).withColumn("canvas_height", F.col("data_height") + info + TITLE_HEIGHT)


def device_rows(trace: DataFrame) -> DataFrame:
    """(trace_id, dev_id, row, title): devices with events, top to bottom."""
    w = Window.partitionBy("trace_id").orderBy("dev_id")
    return trace.select("trace_id", "dev_id").distinct().withColumn("row", (F.row_number().over(w) - 1).cast("int")).withColumn(
        "title", F.concat(F.lit("Device "), F.col("dev_id").cast("string"))
    )


def color(event_type: Column, chunk: Column, max_chunk: Column) -> Column:
    """Hex colour of a type, lighter for later chunks."""
    light = chunk * LIGHTEN / max_chunk / 100

    def part(i: int) -> Column:
        base = reduce(lambda c, kv: c.when(event_type == kv[0], F.lit(kv[1][i])), list(COLORS.items())[1:], F.when(event_type == "FWD", F.lit(COLORS["FWD"][i])))
        value = F.floor(base + (255 - base) * light)
        return F.lpad(F.lower(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), value)))), 2, "0")

    return F.concat(F.lit("#"), part(0), part(1), part(2))


def bars(trace: DataFrame) -> DataFrame:
    """One bar per event, in units of the drawing."""
    sizes = summary(trace).select("trace_id", "first_time", "time_per_unit", "max_chunk").where(F.col("time_per_unit") > 0)
    x = trace.join(sizes, "trace_id").join(device_rows(trace).select("trace_id", "dev_id", "row"), ["trace_id", "dev_id"])
    start = (F.lit(BORDER) + F.floor((F.col("ts") - F.col("first_time")) / F.col("time_per_unit"))).cast("long")
    width = F.floor(F.col("dur") / F.col("time_per_unit"))
    y = (F.col("row") * SPAN + (F.col("row") + 1) * BORDER).cast("int")
    return x.select(
        "trace_id", "dev_id", "seq", "event_num", "name", start.alias("x"), width.alias("width"), y.alias("y"),
        (start + F.floor(width / 2)).alias("center"), color(F.col("event_type"), F.coalesce("chunk_id", F.lit(0)), F.col("max_chunk")).alias("color"),
    )


def legend(trace: DataFrame) -> DataFrame:
    """Types in the order in which the drawing meets them, with label, colour and place."""
    first = trace.groupBy("trace_id", "event_type").agg(F.min(F.struct("dev_id", "seq")).alias("at"))
    w = Window.partitionBy("trace_id")
    x = first.withColumn("position", (F.row_number().over(w.orderBy("at")) - 1).cast("int")).withColumn("n", F.count(F.lit(1)).over(w))
    x = x.join(summary(trace).select("trace_id", "canvas_width"), "trace_id")
    place = F.floor(F.col("canvas_width") / (F.col("n") + 2)) * (F.col("position") + 1)
    return x.select(
        "trace_id", "event_type", "position", F.lower(F.substring("event_type", 1, 3)).alias("label"), place.alias("x"),
        color(F.col("event_type"), F.lit(0), F.lit(1)).alias("color"),
    )
