"""Nested JSON records as related flat tables.

Each record is streamed into path-value-ordinal triples (:func:`record_triples`).  A
triple belongs to the nearest object that is an array element (its *owner*,
``$`` for the root); owners whose paths differ only in indexes form one table.
An owner lies within one record, so :func:`flat` groups the triples by owner and pivots them in the pass itself: once an
owner closes, its row is complete, with its fields in a map, its path, and the path of its parent as the link.
:func:`table` and :func:`tables` spread the maps of one table, or of each, into columns; :func:`triples` gives the
triples themselves.

Defined cases: a null, empty, cut-off or otherwise invalid text gives no
rows; JSON nulls give null columns, missing and null fields look alike; an empty object in an
array is a row without values; scalars in an array become one JSON text of the array, nested
arrays kept, objects left out as they are rows of their own, and an empty array ``[]``; of equal names in one object the
last holds, of equal fields (a name may hold a dot) the greatest; extra columns are ignored unless
named in ``carry``, where a clashing name gets an underscore.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from json.encoder import encode_basestring as quoted

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracewright.plans.durable import cut
from tracewright.plans.names import carried
from tracewright.sources.jsonstream import events

#: More columns than this in one table are refused rather than spread; :func:`flat` has no such bound.
MAX_FIELDS = 4000
#: Rows gathered before an Arrow batch is sent on.
FLUSH = 10_000

_TRIPLE = [
    T.StructField("table_path", T.StringType()),
    T.StructField("parent_path", T.StringType()),
    T.StructField("child_path", T.StringType()),
    T.StructField("field", T.StringType()),
    T.StructField("ordinal", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("element", T.BooleanType()),
]


class Shape:
    """A place in the records, whatever the indexes: its table and its field in it.  Shapes are made once and kept."""

    __slots__ = ("field", "item", "kids", "plain", "table")

    def __init__(self, plain: str, table: str, field: str) -> None:
        self.plain, self.table, self.field = plain, table, field
        self.kids: dict[str, Shape] = {}
        self.item: Shape | None = None

    def child(self, name: str) -> Shape:
        found = self.kids.get(name)
        if found is None:
            dot = lambda a: f"{a}.{name}" if a else name
            found = self.kids[name] = Shape(dot(self.plain), self.table, dot(self.field))
        return found

    def element(self) -> Shape:
        """The objects of the array at this place."""
        if self.item is None:
            self.item = Shape(self.plain, self.plain, "")
        return self.item


#: (shape, parent's path, owner's path, ordinal, kind, value, indexes within the array or None)
Triple = tuple[Shape, str, str, int, str, str | None, str | None]


def record_triples(text: str | None, root: Shape) -> Iterator[Triple]:
    """Triples of one record in document order; kind ``object`` starts an owner and ``end`` closes it, ``array`` is an empty array."""
    stream = events(text)
    first = next(stream, None)
    if first is None:
        return
    yield root, "", "$", 0, "object", None, None
    # open containers: shape, path, owner, owner's owner, next index (-1 for an object), indexes of the arrays around
    stack: list[list] = []
    n = 0
    kind, name, value = first
    while True:
        if kind == "end":
            shape, path, owner, up, index, trail = stack.pop()
            if index == 0:
                yield shape, up, owner, n, "array", "[]", trail
            elif index == -1 and path == owner:
                yield shape, up, owner, n, "end", None, None
            if not stack:
                break
        else:
            n += 1
            if stack:
                shape, path, owner, up, index, trail = top = stack[-1]
                if index >= 0:
                    top[4] = index + 1
            else:
                shape, path, owner, up, index, trail = root, "", "$", "", -1, None
            if kind == "object":
                if index >= 0:
                    path, shape = f"{path}[{index}]", shape.element()
                    up, owner = owner, path
                    yield shape, up, owner, n, "object", None, None
                elif name is not None:
                    path, shape = f"{path}.{name}" if path else name, shape.child(name)
                stack.append([shape, path, owner, up, -1, None])
            elif kind == "array":
                if index >= 0:
                    path, trail = f"{path}[{index}]", f"{trail or ''}[{index}]"
                elif name is not None:
                    path, shape, trail = f"{path}.{name}" if path else name, shape.child(name), None
                stack.append([shape, path, owner, up, 0, trail])
            else:
                if index >= 0:
                    yield shape, up, owner, n, kind, value, f"{trail or ''}[{index}]"
                else:
                    yield (shape.child(name) if name is not None else shape), up, owner, n, kind, value, None
                if not stack:
                    break
        kind, name, value = next(stream)
    yield root, "", "$", n, "end", None, None


def _source(df: DataFrame, text: str, carry: Sequence[str], own: list[T.StructField]) -> tuple[DataFrame, list[str], T.StructType]:
    names = carried(carry, [f.name for f in own])
    source = df.select(*[F.col(c).alias(n) for c, n in zip(carry, names, strict=True)], F.col(text).alias("__text"))
    return source, names, T.StructType([*source.schema.fields[: len(names)], *own])


def triples(df: DataFrame, text: str, carry: Sequence[str], tables: Sequence[str] | None = None) -> DataFrame:
    """(carry..., table_path, parent_path, child_path, field, ordinal, kind, value, element) of each record.

    One triple of kind ``object`` and empty field stands for each owner itself; ``element`` marks values
    of an array.  With ``tables``, the triples of these only.
    """
    source, names, schema = _source(df, text, carry, _TRIPLE)
    arrow = to_arrow_schema(schema)
    wanted = None if tables is None else set(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = Shape("", "$", "")
        for batch in batches:
            at: list[int] = []
            rows: list[tuple] = []

            def flush(batch=batch, at=at, rows=rows) -> pa.RecordBatch:
                cols = [batch[c].take(pa.array(at, pa.int64())) for c in names]
                cols += [pa.array(c, arrow.field(len(names) + i).type) for i, c in enumerate(zip(*rows, strict=True))]
                at.clear(), rows.clear()
                return pa.RecordBatch.from_arrays(cols, schema=arrow)

            for i in range(batch.num_rows):
                for shape, up, owner, n, kind, value, trail in record_triples(batch["__text"][i].as_py(), root):
                    if kind != "end" and (wanted is None or shape.table in wanted):
                        at.append(i)
                        rows.append((shape.table, up or None, owner, shape.field, n, kind, value, trail is not None))
                if len(rows) >= FLUSH:
                    yield flush()
            if rows:
                yield flush()

    return source.mapInArrow(run, schema)


def _listed(cells: list[tuple[str, str]]) -> str:
    """JSON text of an array from its values with their indexes; nested arrays stay nested."""
    out: list[str] = ["["]
    opened: list[str] = []
    for trail, shown in cells:
        inner = trail[1:-1].split("][")[:-1]
        same = next((i for i, (a, b) in enumerate(zip(opened, inner, strict=False)) if a != b), min(len(opened), len(inner)))
        out += ["]"] * (len(opened) - same)
        if out[-1] != "[":
            out.append(",")
        out += ["["] * (len(inner) - same)
        out.append(shown)
        opened = inner
    return "".join(out) + "]" * (len(opened) + 1)


def flat(df: DataFrame, text: str, carry: Sequence[str], tables: Sequence[str] | None = None) -> DataFrame:
    """(carry..., table_path, parent_path, child_path, fields): every row of every table, all fields found in a map of texts.

    The rows of one ``table_path`` are one flat table; the root of each record is its row of the table ``$``.
    With ``tables``, the rows of these only.
    """
    own = [*_TRIPLE[:3], T.StructField("fields", T.MapType(T.StringType(), T.StringType()))]
    source, names, schema = _source(df, text, carry, own)
    arrow = to_arrow_schema(schema)
    wanted = None if tables is None else set(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = Shape("", "$", "")
        for batch in batches:
            at: list[int] = []
            links: tuple[list, list, list] = ([], [], [])
            offsets, keys, values = [0], [], []

            def flush(batch=batch, at=at, links=links, offsets=offsets, keys=keys, values=values) -> pa.RecordBatch:
                cols = [batch[c].take(pa.array(at, pa.int64())) for c in names]
                cols += [pa.array(x, pa.string()) for x in links]
                cols.append(pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string())))
                out = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)
                for x in (at, *links, offsets, keys, values):
                    x.clear()
                offsets.append(0)
                return out

            for i in range(batch.num_rows):
                rows: list[tuple[dict, dict]] = []  # of the owners that are open
                for shape, up, owner, _, kind, value, trail in record_triples(batch["__text"][i].as_py(), root):
                    if kind == "object":
                        rows.append(({}, {}))
                    elif kind == "end":
                        fields, lists = rows.pop()
                        if wanted is not None and shape.table not in wanted:
                            continue
                        for f, cells in lists.items():
                            fields[f] = _listed(cells)
                        at.append(i)
                        for x, v in zip(links, (shape.table, up or None, owner), strict=True):
                            x.append(v)
                        keys.extend(fields)
                        values.extend(fields.values())
                        offsets.append(len(keys))
                        if len(at) >= FLUSH:
                            yield flush()
                    elif trail is not None:
                        shown = quoted(value) if kind == "string" else value
                        rows[-1][1].setdefault(shape.field, []).append((trail, shown))
                    else:
                        fields, field = rows[-1][0], shape.field
                        if kind == "null":
                            fields.setdefault(field, None)
                        elif fields.get(field) is None or value > fields[field]:
                            fields[field] = value
            if at:
                yield flush()

    return source.mapInArrow(run, schema)


def table(rows: DataFrame, path: str, fields: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One flat table from rows of :func:`flat`: (keys..., child_path, parent_path, fields...), values as text."""
    own = rows.where(F.col("table_path") == path)
    return own.select(*keys, "child_path", "parent_path", *[F.element_at("fields", F.lit(f)).alias(f) for f in fields])


def tables(df: DataFrame, text: str, keys: Sequence[str]) -> dict[str, DataFrame]:
    """Every flat table of the records, by its path; each row links to its parent by ``parent_path``.

    The records are read once: their rows are kept in order of table, so that a table skips most of the others'.
    """
    rows = cut(flat(df, text, keys).sortWithinPartitions("table_path"))
    names = carried(keys, [f.name for f in _TRIPLE[:3]] + ["fields"])
    every = rows.select("table_path", F.explode_outer(F.map_keys("fields")).alias("f")).distinct().limit(MAX_FIELDS + 1).collect()
    if len(every) > MAX_FIELDS:
        raise ValueError(f"more than {MAX_FIELDS} distinct fields; take the rows of flat() instead")
    found: dict[str, list[str]] = {}
    for r in sorted(every, key=lambda r: (r["table_path"], r["f"] or "")):
        found.setdefault(r["table_path"], []).extend([r["f"]] if r["f"] is not None else [])
    return {path: table(rows, path, fields, names) for path, fields in found.items()}
