"""Drawing a laid-out trace as SVG."""

from __future__ import annotations

from functools import reduce
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.layout import BORDER, FONT, SPAN, TITLE_WIDTH, bars, device_rows, legend, summary

#: A drawing with more events than this is refused.
MAX_EVENTS = 200_000


def _rect(x: float, y: float, w: float, h: float, fill: str) -> str:
    return f'<rect x="{x:g}" y="{y:g}" width="{w:g}" height="{h:g}" fill={quoteattr(fill)} stroke="black" stroke-width="{BORDER}"/>'


def _text(x: float, y: float, size: float, text: str, anchor: str = "middle") -> str:
    return f'<text x="{x:g}" y="{y + size - 3:g}" font-size="{size:g}" text-anchor="{anchor}" font-family="Times New Roman">{escape(text)}</text>'


def elements(trace: DataFrame) -> DataFrame:
    """(trace_id, layer, at, tag, x, y, width, height, fill, text): everything that is drawn of each trace, in order of layer and place.

    Layers: 0 device titles, 1 base lines, 2 bars, 3 their names, 4 the word for time, 5 legend boxes, 6 legend labels.
    """
    size = summary(trace).where(F.col("time_per_unit") > 0).select("trace_id", F.col("data_height").alias("h"), (F.col("canvas_width") - TITLE_WIDTH).alias("w"))
    num = lambda c: (c if isinstance(c, Column) else F.lit(c)).cast("double")

    def layer(df: DataFrame, n: int, at: Column, tag: str, x, y, width=0, height=0, fill: Column | None = None, text: Column | None = None) -> DataFrame:
        empty = F.lit(None).cast("string")
        return df.select(
            "trace_id", F.lit(n).alias("layer"), at.cast("long").alias("at"), F.lit(tag).alias("tag"), num(x).alias("x"), num(y).alias("y"), num(width).alias("width"),
            num(height).alias("height"), (empty if fill is None else fill).alias("fill"), (empty if text is None else text).alias("text"),
        )

    rows = device_rows(trace).join(size, "trace_id")
    top = F.col("row") * SPAN + (F.col("row") + 1) * BORDER
    drawn = bars(trace)
    place = F.row_number().over(Window.partitionBy("trace_id").orderBy("dev_id", "seq"))
    drawn = drawn.withColumn("at", place)
    names = legend(trace).join(size, "trace_id")
    low = F.col("h") + int(SPAN * 1.6) + BORDER
    return reduce(DataFrame.unionByName, [
        layer(rows, 0, F.col("row"), "text", 12, top, text=F.col("title")),
        layer(rows, 1, F.col("row"), "line", TITLE_WIDTH, top + SPAN, F.col("w") - 1),
        layer(drawn, 2, F.col("at"), "rect", F.col("x") + TITLE_WIDTH, F.col("y"), F.col("width"), SPAN, F.col("color")),
        layer(drawn, 3, F.col("at"), "text", F.col("center") + TITLE_WIDTH, F.col("y") + SPAN / 5, text=F.coalesce("name", F.lit(""))),
        layer(size, 4, F.lit(0), "text", 12, F.col("h"), text=F.lit("Time")),
        layer(names, 5, F.col("position"), "rect", F.col("x"), low, 50, SPAN, F.col("color")),
        layer(names, 6, F.col("position"), "text", F.col("x") + 56, low, text=F.col("label")),
    ])


def draw(trace: DataFrame, path: str, title: str = "Title") -> int:
    """Write one trace to ``path``; returns the number of bars.  Elements come in order, partition by partition."""
    n = trace.count()
    if n > MAX_EVENTS:
        raise ValueError(f"{n} events are too many to draw; filter the trace first")
    size = summary(trace).first()
    if size is None or size["canvas_width"] is None:
        raise ValueError("nothing to draw: no events, or an event without name or duration")
    w, h, rows = int(size["canvas_width"]), int(size["canvas_height"]), int(size["data_height"])
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'<svg xmlns="http://www.w3.org/2000/svg" width="{w}" height="{h}" viewBox="0 0 {w} {h}">\n')
        for e in elements(trace).orderBy("layer", "at").toLocalIterator():
            if e["tag"] == "rect":
                f.write(_rect(e["x"], e["y"], e["width"], e["height"], e["fill"]) + "\n")
                n += e["layer"] == 2
            elif e["tag"] == "line":
                f.write(f'<line x1="{e["x"]:g}" y1="{e["y"]:g}" x2="{e["x"] + e["width"]:g}" y2="{e["y"]:g}" stroke="black" stroke-width="{BORDER}"/>\n')
            else:
                bar = e["layer"] == 3
                f.write(_text(e["x"], e["y"], FONT * 0.6 if bar else FONT, e["text"], "middle" if bar else "start") + "\n")
        y = rows + SPAN // 2 + BORDER + 1
        f.write(f'<path d="M130 {y}H230l-6 -6M230 {y}l-6 6" stroke="black" fill="none" stroke-width="2"/>\n')
        f.write(_text(w / 2, h - 90, FONT * 2, title) + "\n</svg>\n")
    return n


def only(trace: DataFrame, trace_id: str) -> DataFrame:
    return trace.where(F.col("trace_id") == trace_id)
