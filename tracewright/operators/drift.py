"""Schemas that drift between the files of a stream: changes, versions, migration steps, one steady table.

Every record is streamed by the JSON reader; its fields (paths without indexes) are profiled by type and kind of
values (:func:`file_schemas`): sums, extremes and min-hashes only, made for whole batches at once, so a file of any size
is pre-aggregated before the shuffle.  Each file then has one bounded row: its fields and a fingerprint of (path, type).
A file is compared with the stream's previous existing one (:func:`history`); equal fingerprints make one version
and need no look at fields, others give the explicit steps from version to version: rename, cast, default, add.
All changes are read off these steps (:func:`changes`).

A vanished and a new field of the same parent are one renamed field when type, kind of values and name agree well
enough (:func:`likeness`, :func:`affinity`); the best pairs are taken first.

:func:`routes` chains the renames of each stream, from every version to the stream's last one; names that some stream linked by
a rename are then one column over all streams, called by the commonest name, but where two fields of one version would
meet in one column, they stay apart in that whole stream, each in a column of its own name.  :func:`steady_table` joins
each record with the route of its file and takes it through rename, cast and default.

Defined cases: null, empty and invalid texts hold no fields; a field whose
values are all null is not in the file; a file without valid records still is
the stream's previous file, one without fields; a field of several types in one file
counts with the commonest (ties: the first in alphabetical order); a name that
holds a dot is read as two names; repeated records change no set of fields;
an empty input gives empty results; extra columns are ignored unless carried, where a clashing name gets an underscore.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from functools import reduce
from json.encoder import encode_basestring as quoted

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracewright.plans.durable import broadcast_if_small, cut, cut_counted, row_bytes
from tracewright.plans.names import carried
from tracewright.sources.jsonstream import Event, events

HASHES = 16
#: Scalars gathered before the profiles made of them are sent on.
GATHERED = 1_000_000
#: Files of a stream that are compared in one task; a longer stream is compared in stripes of so many file numbers.
STRIPE = 4096
_MASK = (1 << 63) - 1
_SEEDS = [(0x9E3779B97F4A7C15 * (2 * i + 1)) & ((1 << 64) - 1) | 1 for i in range(HASHES)]
_SUMS = ["n", "whole", "broken", "logic", "words", "length", "logs"]
_WORD = re.compile(r"[^\W\d]\w*\Z")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\Z")

#: Likeness of values that a pair needs: with a word in common, with names that look alike, with unlike names.
LIKE_SHARED, LIKE, VERY_LIKE = 0.25, 0.45, 0.97


class _Field:
    """A place in the records of one file: its names below and the number of its profile for each type."""

    __slots__ = ("kids", "path", "profiles")

    def __init__(self, path: str) -> None:
        self.path, self.kids, self.profiles = path, {}, {}


class _Profiles:
    """Profiles of the fields of some files, gathered value by value and added up at once."""

    def __init__(self) -> None:
        self.files: dict[tuple, _Field] = {}
        self.owners: list[tuple[tuple, _Field, str]] = []  # of each profile: file, field, type
        self.nodes: list[int] = []  # profiles of the containers met
        self.leaves: list[int] = []  # profiles of the scalars met, and the codes of their values
        self.codes: list[int] = []
        self.values: dict[str, int] = {}

    def add(self, key: tuple, text: str | None) -> None:
        """Add a record's fields."""
        root = self.files.get(key)
        if root is None:
            root = self.files[key] = _Field("")
        owners, nodes, leaves, codes, values = self.owners, self.nodes, self.leaves, self.codes, self.values
        stack: list[tuple[_Field, bool]] = []
        field, listed = root, True  # the root itself is no field
        for kind, name, value in events(text):
            if kind == "end":
                stack.pop()
                if stack:
                    field, listed = stack[-1]
                continue
            if listed:  # elements are no fields of their own; objects in an array have theirs
                here = field
            else:
                here = field.kids.get(name)
                if here is None:
                    here = field.kids[name] = _Field(f"{field.path}.{name}" if field.path else name)
                if kind != "null":
                    at = here.profiles.get(kind)
                    if at is None:
                        at = here.profiles[kind] = len(owners)
                        owners.append((key, here, kind))
                    if value is None:
                        nodes.append(at)
                    else:
                        leaves.append(at)
                        codes.append(values.setdefault(value, len(values)))
            if value is None:
                field, listed = here, kind == "array"
                stack.append((field, listed))

    def summed(self) -> tuple[list[tuple], list[str], list[str], list[np.ndarray]]:
        """Keys, paths, types, and columns of sums, extremes and min-hashes of all profiles; an empty path tells that a file exists."""
        texts, m = list(self.values), len(self.owners)
        number = [_NUMBER.match(v) for v in texts]
        is_number = np.array([x is not None for x in number], bool)
        x = np.array([float(v) if k else 0.0 for v, k in zip(texts, number, strict=True)], float)
        logic = np.array([v in ("true", "false") for v in texts], bool)
        word = np.array([_WORD.match(v) is not None for v in texts], bool) & ~logic
        size = np.array([len(v) for v in texts], float)
        fraction = np.array(["." in v for v in texts], bool) & (x != np.floor(x)) & is_number
        hashed = np.array([0 if k else xxhash.xxh3_64_intdigest(v) for v, k in zip(texts, number, strict=True)], np.uint64)
        leaves, codes = np.array(self.leaves, np.int64), np.array(self.codes, np.int64)
        total = lambda w: np.bincount(leaves, w[codes], m) if len(codes) else np.zeros(m)
        n = np.bincount(np.array([*self.leaves, *self.nodes], np.int64), minlength=m) if m else np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            logs = np.where(is_number, np.log10(1 + np.abs(x)), 0.0)
        sums = [n, total(is_number & ~fraction), total(fraction), total(logic), total(word), total(size)]
        low, high = np.full(m, math.inf), np.full(m, -math.inf)
        counted = is_number[codes]
        np.minimum.at(low, leaves[counted], x[codes[counted]])
        np.maximum.at(high, leaves[counted], x[codes[counted]])
        sketch = np.full((m, HASHES), _MASK, np.int64)
        pairs = np.unique(leaves[~counted] * max(len(texts), 1) + codes[~counted])  # each value once a profile
        self._mix(sketch, pairs // max(len(texts), 1), hashed[pairs % max(len(texts), 1)])
        kids = [(f.profiles.get("array", f.profiles.get("object")), "." + name) for f in {id(f): f for _, f, k in self.owners if k in ("array", "object")}.values() for name, kid in f.kids.items() if kid.profiles]
        if kids:  # the names below a container are its kind of values
            self._mix(sketch, np.array([k for k, _ in kids]), np.array([xxhash.xxh3_64_intdigest(v) for _, v in kids], np.uint64))
        bare = len(self.files)
        wide = lambda c, fill, kind: np.concatenate([c, np.full(bare, fill)]).astype(kind)
        columns = [wide(c, 0, np.int64) for c in sums] + [wide(total(logs), 0, float), wide(low, math.inf, float), wide(high, -math.inf, float)]
        columns += [wide(sketch[:, i], _MASK, np.int64) for i in range(HASHES)]
        owners = self.owners
        return [*[o[0] for o in owners], *self.files], [*[o[1].path for o in owners], *[""] * bare], [*[o[2] for o in owners], *[""] * bare], columns

    @staticmethod
    def _mix(sketch: np.ndarray, at: np.ndarray, hashes: np.ndarray) -> None:
        order = np.argsort(at, kind="stable")
        at, hashes = at[order], hashes[order]
        if not len(at):
            return
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        h = hashes ^ (hashes >> np.uint64(29))
        for i, seed in enumerate(_SEEDS):
            least = np.minimum.reduceat(((h * np.uint64(seed)) >> np.uint64(1)).view(np.int64), first)
            sketch[at[first], i] = np.minimum(sketch[at[first], i], least)


def file_schemas(df: DataFrame, text: str, stream: str, file: str) -> DataFrame:
    """(stream, file, fields, fingerprint): one row per existing file."""
    source = df.select(F.col(stream).alias("stream"), F.col(file).alias("file"), F.col(text).alias("text"))
    flat = T.StructType(
        [*source.schema.fields[:2], T.StructField("path", T.StringType()), T.StructField("type", T.StringType())]
        + [T.StructField(c, T.LongType()) for c in _SUMS[:-1]]
        + [T.StructField(c, T.DoubleType()) for c in ("logs", "lo", "hi")]
        + [T.StructField(f"h{i}", T.LongType()) for i in range(HASHES)]
    )
    arrow = to_arrow_schema(flat)

    def sent(profiles: _Profiles) -> pa.RecordBatch:
        keys, paths, types, columns = profiles.summed()
        first = [pa.array([k[i] for k in keys], arrow.field(i).type) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([*first, pa.array(paths, pa.string()), pa.array(types, pa.string()), *map(pa.array, columns)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            profiles = _Profiles()
            keys = zip(batch["stream"].to_pylist(), batch["file"].to_pylist(), strict=True)
            for key, value in zip(keys, batch["text"], strict=True):
                profiles.add(key, value.as_py())
                if len(profiles.leaves) >= GATHERED:
                    yield sent(profiles)
                    profiles = _Profiles()
            if profiles.files:
                yield sent(profiles)

    sums = [F.sum(c).alias(c) for c in _SUMS]
    least = [F.min("lo").alias("lo"), F.max("hi").alias("hi"), *[F.min(f"h{i}").alias(f"h{i}") for i in range(HASHES)]]
    fields = source.mapInArrow(run, flat).groupBy("stream", "file", "path", "type").agg(*sums, *least)
    short = [F.lpad(F.hex(F.pmod(F.col(f"h{i}"), F.lit(65536))), 4, "0") for i in range(HASHES)]  # 16 bits tell equal minima well enough
    one = F.struct("path", "type", *_SUMS, "lo", "hi", F.concat(*short).alias("sketch"))
    listed = F.array_sort(F.collect_list(F.when(F.col("path") != "", one)))
    spelled = F.array_join(F.transform("fields", lambda f: F.concat_ws(":", f["path"], f["type"])), ",")
    return fields.groupBy("stream", "file").agg(listed.alias("fields")).withColumn("fingerprint", F.md5(spelled))


_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def _within(short: str, long: str) -> bool:
    """``short`` starts like ``long`` and its letters come in order in it."""
    if not short or short[0] != long[0]:
        return False
    at = iter(long)
    return all(c in at for c in short)


def affinity(a: str, b: str) -> float:
    """How much two names look like one name, 0 to 1: shared words, shared beginnings, abbreviations."""
    if a.lower() == b.lower():
        return 1.0
    x = [t.lower() for t in _CAMEL.findall(a)]
    y = [t.lower() for t in _CAMEL.findall(b)]
    common = set(x) & set(y)
    if common:
        return 0.9
    best = 0.0
    for s in [*x, "".join(x)]:
        for t in [*y, "".join(y)]:
            short, long = sorted((s, t), key=len)
            same = next((i for i, (p, q) in enumerate(zip(short, long, strict=False)) if p != q), len(short))
            if same >= 4 or same == len(short) >= 3:
                best = max(best, 0.8)
            elif len(short) >= 2 and _within(short, long):
                best = max(best, 0.6)
    return best


def likeness(a: dict, b: dict) -> float:
    """How much the values of two fields of one type are of one kind, 0 to 1."""
    if a["type"] != b["type"]:
        return 0.0
    n, m = max(1, a["n"]), max(1, b["n"])
    same = sum(a["sketch"][i : i + 4] == b["sketch"][i : i + 4] for i in range(0, 4 * HASHES, 4)) / HASHES
    if a["type"] in ("object", "array"):
        bare = [p["sketch"] == "FFFF" * HASHES for p in (a, b)]
        return same if not any(bare) else (1.0 if all(bare) else 0.5)
    share = lambda p, k, c: p[c] / k
    classes = ("whole", "broken", "logic", "words")
    apart = sum(abs(share(a, n, c) - share(b, m, c)) for c in classes)
    mix = max(0.0, 1 - apart / 2)
    num_a, num_b = a["whole"] + a["broken"], b["whole"] + b["broken"]
    if num_a > n / 2 and num_b > m / 2:
        gap = abs(a["logs"] / num_a - b["logs"] / num_b)
        size = max(0.0, 1 - gap)
        wide = max(a["hi"], b["hi"]) - min(a["lo"], b["lo"])
        over = min(a["hi"], b["hi"]) - max(a["lo"], b["lo"])
        if gap >= 1 and over < 0:
            return 0.0  # apart, and of another size
        cover = 1.0 if wide <= 0 else max(0.0, over / wide)
        # small samples of one field may differ in fractional digits and in range
        return 0.3 * mix + 0.5 * size + 0.2 * cover
    long_a, long_b = a["length"] / n, b["length"] / m
    shape = min(long_a, long_b) / max(long_a, long_b, 1e-9)
    return max(same, 0.5 * mix + 0.4 * shape) if mix > 0.5 else 0.0


class Fields:
    """The fields of one file as columns; all but path, type and number are read only where two fields are compared."""

    def __init__(self, rows: pa.StructArray, paths: list[str], types: list[str], counts: list[int], start: int) -> None:
        self.rows, self.start = rows, start
        self.at: dict[str, int] = {}
        for i in sorted(range(len(paths)), key=lambda i: (-counts[i], types[i])):
            self.at.setdefault(paths[i], i)  # of several types the commonest
        self.types = {p: types[i] for p, i in self.at.items()}

    def __getitem__(self, path: str) -> dict:
        return self.rows[self.start + self.at[path]].as_py()


def _columns(batch: pa.RecordBatch, name: str) -> list[Fields]:
    """One :class:`Fields` per row of a column of field arrays; a null array has no fields."""
    column = batch[name]
    rows, offsets = column.values, column.offsets.to_pylist()
    paths, types, counts = (rows.field(c).to_pylist() for c in ("path", "type", "n"))
    out = []
    for i, known in enumerate(column.is_valid().to_pylist()):
        a, b = (offsets[i], offsets[i + 1]) if known else (0, 0)
        out.append(Fields(rows, paths[a:b], types[a:b], counts[a:b], a))
    return out


def diff_schemas(before: Fields, after: Fields) -> list[tuple[str, str, str]]:
    """(kind, old path, new path) of what changed, topmost changes only."""
    old, new = before.types, after.types

    def seen(path: str) -> bool:
        """All that is around a field is in both files and of one type."""
        while "." in path:
            path = path.rpartition(".")[0]
            if path in old or path in new:  # a name that holds a dot has no parent of its own
                if old.get(path) != new.get(path):
                    return False
        return True

    gone = [p for p in old if p not in new and seen(p)]
    come: dict[str, list[str]] = {}
    for q in new:
        if q not in old and seen(q):
            come.setdefault(q.rpartition(".")[0], []).append(q)
    out = [("retyped", p, p) for p in old if p in new and old[p] != new[p] and seen(p)]
    pairs = []
    for p in gone:
        parent, _, name = p.rpartition(".")
        for q in come.get(parent, ()):
            if old[p] != new[q]:
                continue
            like, near = likeness(before[p], after[q]), affinity(name, q.rpartition(".")[2])
            if like >= (LIKE_SHARED if near >= 0.9 else LIKE if near >= 0.6 else VERY_LIKE):
                pairs.append((-(like + near), p, q))
    was, now = {}, set()
    for _, p, q in sorted(pairs):
        if p not in was and q not in now:
            was[p] = q
            now.add(q)
    out += [("renamed", p, q) for p, q in was.items()]
    out += [("removed", p, "") for p in gone if p not in was]
    return out + [("added", "", q) for qs in come.values() for q in qs if q not in now]


#: The action of a migration step for each kind of change, in the order in which they are taken: renames first, so that casts find their field.
ACTIONS = {"renamed": "rename", "retyped": "cast", "removed": "default", "added": "add"}


def _steps(before: Fields, after: Fields) -> list[tuple[str, str, str]]:
    """(action, path, target) from one version to the next, in order."""
    order = list(ACTIONS)
    out = []
    for kind, a, b in sorted(diff_schemas(before, after), key=lambda c: (order.index(c[0]), c[1] or c[2])):
        target = b if kind == "renamed" else "null" if kind == "removed" else after.types[b]
        out.append((ACTIONS[kind], a or b, target))
    return out


def _stripe(schemas: DataFrame) -> Column:
    whole = isinstance(schemas.schema["file"].dataType, (T.IntegerType, T.LongType, T.ShortType))
    return F.floor(F.col("file") / STRIPE).cast("long") if whole else F.lit(0).cast("long")


def _followed(schemas: DataFrame) -> DataFrame:
    """Each file with its version and, where a version starts, the fields of the stream's previous existing file.

    One shuffle by stream and stripe; only stripes' last files are handed on to the next stripe.
    """
    x = schemas.withColumn("__stripe", _stripe(schemas))
    part = ["stream", "__stripe"]
    w = Window.partitionBy(*part).orderBy("file")
    along = Window.partitionBy("stream").orderBy("__stripe")
    ends = x.groupBy(*part).agg(F.max_by(F.struct("file", "fingerprint"), "file").alias("__end"))
    carried_on, n = cut_counted(ends.withColumn("__from", F.lag("__end").over(along)).where("__from IS NOT NULL").select(*part, "__from"))
    x = x.withColumns({"__was": F.lag("fingerprint").over(w), "before": F.lag("fields").over(w), "__first": F.row_number().over(w) == 1})
    if n:  # streams of several stripes
        last = carried_on.select("stream", "__stripe", F.col("__from.file").alias("__file"), F.col("__from.fingerprint").alias("__print"))
        fields = schemas.select("stream", F.col("file").alias("__file"), F.col("fields").alias("__fields"))
        heads = last.join(fields, ["stream", "__file"]).select(*part, "__print", "__fields", F.lit(True).alias("__first"))
        x = x.join(heads, [*part, "__first"], "left").withColumns({"__was": F.coalesce("__was", "__print"), "before": F.coalesce("before", "__fields")}).drop("__print", "__fields")
    fresh = F.col("__was").isNull() | (F.col("__was") != F.col("fingerprint"))
    x = x.withColumn("fresh", fresh).withColumn("before", F.when(fresh, F.col("before")))
    x = x.withColumn("version", F.sum(F.col("fresh").cast("int")).over(w).cast("int"))
    if n:
        counts = x.groupBy(*part).agg(F.sum(F.col("fresh").cast("int")).alias("__n"))
        upto = counts.select(*part, (F.sum("__n").over(along) - F.col("__n")).cast("int").alias("__upto"))
        x = x.join(upto, part).withColumn("version", F.col("version") + F.col("__upto"))
    return x.select("stream", "file", "version", "fingerprint", "fresh", "before", "fields")


def versions(schemas: DataFrame) -> DataFrame:
    """(stream, file, version, fingerprint): a stream's version rises when the fingerprint changes."""
    return _followed(schemas).select("stream", "file", "version", "fingerprint")


def history(schemas: DataFrame) -> DataFrame:
    """(stream, file, version, fields, steps): one row per version of a stream, at its first file, with the steps to it from the one before."""
    fresh = _followed(schemas).where("fresh").select("stream", "file", "version", "before", "fields")
    named = T.StructType([T.StructField("path", T.StringType()), T.StructField("type", T.StringType())])
    step = T.StructType([T.StructField(c, T.StringType()) for c in ("action", "path", "target")])
    schema = T.StructType([*fresh.schema.fields[:3], T.StructField("fields", T.ArrayType(named)), T.StructField("steps", T.ArrayType(step))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            was, now = _columns(batch, "before"), _columns(batch, "fields")
            known = batch["before"].is_valid().to_pylist()
            steps = [[dict(zip(("action", "path", "target"), s, strict=True)) for s in _steps(a, b)] if k else [] for a, b, k in zip(was, now, known, strict=True)]
            kept = [[{"path": p, "type": t} for p, t in sorted(f.types.items())] for f in now]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(kept, arrow.field("fields").type), pa.array(steps, arrow.field("steps").type)], schema=arrow)

    return fresh.mapInArrow(run, schema)


def migration_steps(versions_of: DataFrame) -> DataFrame:
    """(stream, file, from_version, to_version, step, action, path, target) from :func:`history`.

    A renamed field is renamed, a retyped one cast to its new type, a removed one filled with the default null,
    an added one taken over.  Steps run in order of ``step``.
    """
    return versions_of.select("stream", "file", "version", F.posexplode("steps").alias("at", "s")).select(
        "stream", "file", (F.col("version") - 1).alias("from_version"), F.col("version").alias("to_version"), (F.col("at") + 1).alias("step"), "s.*"
    )


def changes(steps: DataFrame) -> DataFrame:
    """(stream, file, change_kind, old_path, new_path) of :func:`migration_steps`: each file against the previous existing one."""
    kind = reduce(lambda c, kv: c.when(F.col("action") == kv[1], kv[0]), list(ACTIONS.items())[1:], F.when(F.col("action") == "rename", "renamed"))
    new = F.when(F.col("action") == "rename", F.col("target")).when(F.col("action") == "default", "").otherwise(F.col("path"))
    old = F.when(F.col("action") == "add", "").otherwise(F.col("path"))
    return steps.select("stream", "file", kind.alias("change_kind"), old.alias("old_path"), new.alias("new_path"))


def _joined(parent: str, name: str) -> str:
    return f"{parent}.{name}" if parent else name


class _Names(dict):
    """path -> path, where a path that is not held follows its parent."""

    def __missing__(self, path: str) -> str:
        parent, _, name = path.rpartition(".")
        return _joined(self[parent], name) if parent else path


def _chained(versions_of: DataFrame) -> DataFrame:
    """(stream, version, paths, types, lasts, spelled, a, b): each path at the end of its stream, the same with its own last name, and pairs that a rename links.

    Versions are streamed from the last one back, with the names of one version held.
    """
    back = versions_of.select("stream", "version", "fields", "steps").repartition("stream").sortWithinPartitions("stream", F.col("version").desc())
    words = T.ArrayType(T.StringType())
    schema = T.StructType([*back.schema.fields[:2], *[T.StructField(c, words) for c in ("paths", "types", "lasts", "spelled", "a", "b")]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, later, moved = object(), _Names(), {}
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for own, fields, steps in zip(batch["stream"].to_pylist(), batch["fields"].to_pylist(), batch["steps"].to_pylist(), strict=True):
                paths = sorted(f["path"] for f in fields)
                lasts, a, b = _Names(), [], []
                if own == stream:
                    after = _Names(moved)
                    for p in paths:
                        q = after[p]
                        parent, _, name = p.rpartition(".")
                        lasts[p] = later[q] if q in later else _joined(lasts[parent] if parent else "", name)
                    for p, q in moved.items():
                        parent = p.rpartition(".")[0]
                        up = lasts[parent] if parent else ""
                        a.append(_joined(up, p.rpartition(".")[2]))
                        b.append(_joined(up, q.rpartition(".")[2]))
                else:
                    lasts.update((p, p) for p in paths)
                types = {f["path"]: f["type"] for f in fields}
                spelled = [_joined(lasts[p.rpartition(".")[0]] if "." in p else "", p.rpartition(".")[2]) for p in paths]
                for c, v in zip(out, (paths, [types[p] for p in paths], [lasts[p] for p in paths], spelled, a, b), strict=True):
                    c.append(v)
                stream, later = own, lasts
                moved = {s["path"]: s["target"] for s in steps if s["action"] == "rename"}
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(c, pa.list_(pa.string())) for c in out]], schema=arrow)

    return back.mapInArrow(run, schema)


#: Distinct names or links up to which their classes are found on the driver; beyond, by joins.
MAX_PATHS = 20_000


def classes_of(paths: list[tuple[str, int]], links: list[tuple[str, str]]) -> dict[str, str]:
    """path -> steady path.  Parents first: below one steady parent, linked names are one, called by the commonest."""
    canon: dict[str, str] = {"": ""}
    weights = dict(paths)
    for a, b in links:
        weights.setdefault(a, 0), weights.setdefault(b, 0)
    for level in sorted({p.count(".") for p in weights}):
        here = sorted(p for p in weights if p.count(".") == level)
        split = {p: (canon.get(p.rpartition(".")[0], p.rpartition(".")[0]), p.rpartition(".")[2]) for p in here}
        weight: dict[tuple[str, str], int] = {}
        root = {s: s for s in split.values()}

        def find(x: tuple[str, str], root=root) -> tuple[str, str]:
            while root[x] != x:
                x = root[x]
            return x

        for p in here:
            weight[split[p]] = weight.get(split[p], 0) + weights[p]
        for a, b in links:
            if a in split and b in split and split[a][0] == split[b][0]:
                x, y = find(split[a]), find(split[b])
                if x != y:
                    root[y] = x
        best: dict[tuple[str, str], tuple[str, str]] = {}
        for s in sorted(weight, key=lambda s: (-weight[s], s)):
            best.setdefault(find(s), s)
        for p in here:
            canon[p] = _joined(*best[find(split[p])])
    del canon[""]
    return canon


_PARENT, _NAME = r"\.?[^.]*$", r"^.*\."


def _split(path: str) -> tuple[Column, Column]:
    """Parent and name of a path column."""
    return F.regexp_replace(F.col(path), _PARENT, ""), F.regexp_replace(F.col(path), _NAME, "")


def _under(parent: Column, name: Column) -> Column:
    return F.when(parent == "", name).otherwise(F.concat(parent, F.lit("."), name))


def _classes_by_joins(paths: DataFrame, links: DataFrame) -> DataFrame:
    """(path, steady) as :func:`classes_of`, for any number of names: level by level, the least linked name is spread by joins."""
    ends = links.select(F.col("a").alias("path")).union(links.select(F.col("b").alias("path"))).distinct().withColumn("n", F.lit(0).cast("long"))
    paths = cut(paths.unionByName(ends).groupBy("path").agg(F.sum("n").alias("n")).withColumn("level", F.length("path") - F.length(F.regexp_replace("path", r"\.", ""))))
    deepest = paths.agg(F.max("level")).first()[0]
    done: DataFrame | None = None

    def steady(df: DataFrame, path: str, to: str) -> DataFrame:
        """With the path of the steady parent and the own name in ``to``."""
        parent, name = _split(path)
        df = df.withColumns({"__p": parent, "__n": name})
        if done is not None:
            df = df.join(done.select(F.col("path").alias("__p"), F.col("steady").alias("__s")), "__p", "left").withColumn("__p", F.coalesce("__s", "__p")).drop("__s")
        return df.withColumn(to, _under(F.col("__p"), F.col("__n"))).drop("__p", "__n")

    for level in range(-1 if deepest is None else deepest + 1):
        here = cut(steady(paths.where(F.col("level") == level), "path", "own"))
        pairs = links.join(here.select(F.col("path").alias("a")), "a", "left_semi")
        pairs = steady(steady(pairs, "a", "x"), "b", "y")
        same = F.regexp_replace(F.col("x"), _PARENT, "") == F.regexp_replace(F.col("y"), _PARENT, "")
        pairs = pairs.where(same).select("x", "y")
        pairs = cut(pairs.union(pairs.select("y", "x")).distinct())
        label = cut(here.select(F.col("own").alias("x")).distinct().withColumn("root", F.col("x")))
        while True:
            least = pairs.join(label.select(F.col("x").alias("y"), "root"), "y").groupBy("x").agg(F.min("root").alias("near"))
            told = label.join(least, "x", "left").select("x", "root", F.least("root", F.coalesce("near", "root")).alias("new"))
            jump = told.join(told.select(F.col("x").alias("new"), F.col("new").alias("far")), "new", "left")
            fresh = cut(jump.select("x", F.least("new", F.coalesce("far", "new")).alias("root"), (F.col("root") != F.least("new", F.coalesce("far", "new"))).alias("moved")))
            moved = fresh.where("moved").limit(1).count()
            label = fresh.select("x", "root")
            if not moved:
                break
        named = here.groupBy("own").agg(F.sum("n").alias("n")).join(label.withColumnRenamed("x", "own"), "own")
        best = named.groupBy("root").agg(F.min_by("own", F.struct(-F.col("n"), "own")).alias("steady"))
        found = cut(here.join(named.select("own", "root"), "own").join(best, "root").select("path", "steady"))
        done = found if done is None else cut(done.unionByName(found))
    return done if done is not None else paths.select("path", F.col("path").alias("steady"))


def routes(versions_of: DataFrame, max_paths: int = MAX_PATHS) -> DataFrame:
    """(stream, version, path, type, steady, apart): where each field of each version of :func:`history` belongs.

    ``apart`` marks fields that would meet another one of their version in a column, and so keep their own name.
    """
    chain = cut(_chained(versions_of))
    every = chain.select(F.explode("spelled").alias("path"), F.lit(1).alias("n")).unionByName(chain.select(F.explode("lasts").alias("path"), F.lit(0).alias("n")))
    names = every.groupBy("path").agg(F.sum("n").alias("n"))
    links = chain.select(F.explode(F.arrays_zip("a", "b")).alias("l")).select("l.a", "l.b").distinct()
    few_names, few_links = (x.limit(max_paths + 1).collect() for x in (names, links))
    if max(len(few_names), len(few_links)) <= max_paths:
        found = classes_of([tuple(r) for r in few_names], sorted(map(tuple, few_links)))
        classes = names.sparkSession.createDataFrame(list(found.items()), "path string, steady string")
        n = len(found)
    else:
        classes, n = cut_counted(_classes_by_joins(names, links))
    rows = chain.select("stream", "version", F.explode(F.arrays_zip("paths", "types", "lasts")).alias("r")).select(
        "stream", "version", F.col("r.paths").alias("path"), F.col("r.types").alias("type"), F.col("r.lasts").alias("last")
    )
    rows = rows.join(broadcast_if_small(classes.withColumnRenamed("path", "last"), n), "last")
    meet = rows.groupBy("stream", "version", "steady").agg(F.count(F.lit(1)).alias("n"), F.collect_set("last").alias("lasts")).where("n > 1")
    apart = meet.select("stream", F.explode("lasts").alias("last")).distinct().withColumn("__apart", F.lit(True))
    rows = rows.join(apart, ["stream", "last"], "left").withColumn("apart", F.coalesce("__apart", F.lit(False)))
    return rows.select("stream", "version", "path", "type", F.when(F.col("apart"), F.col("last")).otherwise(F.col("steady")).alias("steady"), "apart")


#: Columns of a steady table; the fields beyond, the rarest, are in its column of rests.
MAX_COLUMNS = 4000


def steady_columns(routed: DataFrame, limit: int = MAX_COLUMNS) -> dict[str, str]:
    """steady path -> type: the commonest one.  A table's columns have to be known to the driver, so no more than ``limit`` are."""
    votes = routed.groupBy("steady").agg(F.count(F.lit(1)).alias("n"), F.collect_set("type").alias("types"), F.mode("type", True).alias("most"))
    top = votes.orderBy(F.col("n").desc(), "steady").limit(limit).collect()
    return {r["steady"]: _steady_type(set(r["types"]), r["most"]) for r in sorted(top)}


def _steady_type(types: set[str], most: str) -> str:
    """The commonest type; a field that is an array anywhere is ``array``, an object that is also a scalar ``mixed``."""
    if "array" in types:
        return "array"
    return "mixed" if "object" in types and len(types) > 1 else most


def file_routes(schemas: DataFrame, routed: DataFrame) -> tuple[DataFrame, int, int]:
    """(stream, file, moves) of the files with fields that go elsewhere than their parent and name say; its rows, and bytes of a row."""
    every = routed.groupBy("stream", "version").agg(F.map_from_entries(F.collect_list(F.struct("path", "steady"))).alias("all"))
    parent = lambda k: F.regexp_replace(k, _PARENT, "")
    home = lambda k: _under(F.coalesce(F.element_at("all", parent(k)), parent(k)), F.regexp_replace(k, _NAME, ""))
    moves = every.select("stream", "version", F.map_filter("all", lambda k, v: v != home(k)).alias("moves")).where(F.size("moves") > 0)
    found = cut(versions(schemas).select("stream", "file", "version").join(moves, ["stream", "version"]).select("stream", "file", "moves"))
    length = F.aggregate(F.map_entries("moves"), F.lit(0), lambda a, e: a + F.length(e["key"]) + F.length(e["value"]) + 48)
    n, width = found.agg(F.count(F.lit(1)), F.coalesce(F.avg(length), F.lit(0.0))).first()
    return found, n, int(width) + row_bytes(found.schema)


def _cast(value: str | None, kind: str):
    if value is None:
        return None
    if kind == "number":
        m = _NUMBER.match(value)
        return float(value) if m else {"true": 1.0, "false": 0.0}.get(value)
    if kind == "boolean":
        return {"true": True, "false": False, "1": True, "0": False, "1.0": True, "0.0": False}.get(value)
    return value


def _exact(value: str, cell: object) -> bool:
    """Whether a cast kept the value: it fits the type, and a long integer its double."""
    if cell is None:
        return False
    return not (isinstance(cell, float) and len(value) > 15 and value.lstrip("-").isdigit() and (math.isinf(cell) or int(cell) != int(value)))


def _leaf(kind: str, value: str, steady: str) -> str:
    """JSON text of a scalar, cast to the steady type where it fits."""
    if kind == "string" and steady == "number" and _NUMBER.match(value):
        return value
    if kind == "string" and steady == "boolean" and value in ("true", "false"):
        return value
    if kind == "string" or (steady == "string" and kind != "null"):
        return quoted(value)
    return value


class _Node:
    """A place in the records of one file, and where it belongs."""

    __slots__ = ("apart", "calm", "home", "kids", "kind", "plain", "router", "shown", "slot", "steady", "type")

    def __init__(self, router: _Router, plain: str, steady: str, name: str) -> None:
        self.router, self.plain, self.steady, self.kids = router, plain, steady, {}
        at = router.table
        self.slot, self.type = at.column.get(steady), at.types.get(steady, "")
        self.home, self.apart = steady == at.path, steady in at.apart
        self.kind = at.kinds[self.slot] if self.slot is not None else ""
        self.calm = name if "." in name else steady.rpartition(".")[2]
        self.shown = quoted(self.calm) + ":"

    def child(self, name: str) -> _Node:
        found = self.kids.get(name)
        if found is None:
            plain = _joined(self.plain, name)
            found = self.kids[name] = _Node(self.router, plain, self.router.moves.get(plain) or _joined(self.steady, name), name)
        return found


class _Router:
    """The places of all fields of files with equal routes."""

    def __init__(self, table: _Table, moves: dict[str, str]) -> None:
        self.table, self.moves = table, moves
        self.root = _Node(self, "", "", "")


class _Table:
    """What the kernel must know of a steady table."""

    def __init__(self, path: str, types: dict[str, str], apart: Sequence[str], steady: list[tuple[str, str]]) -> None:
        self.path, self.types, self.apart = path, types, set(apart)
        self.column = {c: i for i, (c, _) in enumerate(steady)}
        self.kinds = [t for _, t in steady]
        self.routers: dict[tuple, _Router] = {}

    def router(self, moves: list[tuple[str, str]] | None) -> _Router:
        key = tuple(sorted(moves or ()))
        found = self.routers.get(key)
        if found is None:
            if len(self.routers) >= 5000:  # made anew where needed
                self.routers.clear()
            found = self.routers[key] = _Router(self, dict(key))
        return found


def _rendered(kind: str, event: Event, stream: Iterator[Event], node: _Node) -> tuple[str, Event | None]:
    """JSON text of a container, with steady names and types inside, and the event behind it; ``event`` is the first inside.

    Where two names of one object have one steady name, the later keeps its own, with underscores if that is taken.
    """
    out = ["{" if kind == "object" else "["]
    opened: list[tuple[_Node, bool, set[str]]] = [(node, kind == "array", set())]
    while True:
        kind, name, value = event
        node, listed, names = opened[-1]
        if kind == "end":
            out.append("]" if listed else "}")
            opened.pop()
            event = next(stream, None)
            if not opened:
                return "".join(out), event
            continue
        if out[-1] not in ("{", "["):
            out.append(",")
        if not listed:
            node = node.kids.get(name) or node.child(name)
            if node.calm not in names:
                names.add(node.calm)
                out.append(node.shown)
            else:
                while name in names:
                    name += "_"
                names.add(name)
                out.append(quoted(name) + ":")
        if value is None:
            out.append("{" if kind == "object" else "[")
            opened.append((node, kind == "array", set()))
        else:
            out.append(_leaf(kind, value, "" if listed else node.type))
        event = next(stream)


def _fill(text: str | None, root: _Node, start) -> None:
    """Start a row for each object of the table in one record and fill its cells; what has no place there goes to the last cell."""
    table = root.router.table
    stream = events(text)
    event = next(stream, None)
    if event is None:
        return
    more: dict[str, tuple[list, list[str]]] = {}
    # open containers: node, is an array, path, row of the owner or None, owner, owner's owner, next index
    stack: list[list] = [[root, False, "", None if table.path else start("", "$"), "$", "", 0]]
    depth = 0
    while event is not None:
        kind, name, value = event
        event = next(stream, None)
        if kind == "end":
            stack.pop()
            continue
        node, listed, path, row, owner, up, index = top = stack[-1]
        if listed:
            top[6] += 1
            if value is None:
                path = f"{path}[{index}]"
                if kind == "object":
                    up, owner = owner, path
                    row = start(up, path) if table.path and node.home else None
                stack.append([node, kind == "array", path, row, owner, up, 0])
            continue
        if name is None:  # the record's outermost value
            if depth == 0 and kind == "object":
                depth = 1
                stack.append([root, False, "", row, owner, up, 0])
                continue
            depth = 1
        else:
            node = node.kids.get(name) or node.child(name)
        if value is None:
            inner = _joined(path, name or "")
            empty = event is not None and event[0] == "end"
            walked = row is None or (node.apart if kind == "array" else not empty and (node.slot is None or node.type == "mixed"))
            if walked:
                stack.append([node, kind == "array", inner, row, owner, up, 0])
                continue
            shown, event = _rendered(kind, event, stream, node)
            cell, fits = shown, node.slot is not None
        elif kind == "null" or row is None:
            continue
        else:
            shown = None
            if kind == "number" and node.kind == "number":
                cell = float(value)
                fits = len(value) <= 15 or _exact(value, cell)
            elif node.slot is not None:
                cell = _cast(value, node.kind)
                fits = _exact(value, cell)
            else:
                cell, fits = None, False
        if node.slot is not None and row[node.slot] is None:
            row[node.slot] = cell
        else:
            fits = False
        if not fits:
            if shown is None:
                shown = quoted(value) if kind == "string" else value
            inner = _joined(path, name or "")
            field = inner[0 if owner == "$" else len(owner) + 1 :]
            more.setdefault(owner, (row, []))[1].append(f"{quoted(field)}:{shown}")
    for row, parts in more.values():
        row[-1] = "{" + ",".join(parts) + "}"


def steady_table(
    df: DataFrame, text: str, carry: Sequence[str], moves: str, types: dict[str, str], table: str, rest: str | None = None, apart: Sequence[str] = ()
) -> DataFrame:
    """(carry..., parent_path, child_path, steady columns): the objects of one steady table, whatever their file called things.

    ``moves`` names the column with the route of the record's file (:func:`routed_records`), ``types`` are the
    :func:`steady_columns`.  The table ``""`` holds the roots, one row per record; ``apart`` names arrays of it that have tables of their own.
    An array, or an object without fields, is a string column of JSON text with steady names inside; so is a field that
    is an array or an object in some files and a scalar in others.  A field missing from a record takes the default null.
    Columns are named by the steady path below the table, dots as underscores.
    A column ``rest``, if named, holds as JSON text, by the names in the payload, what has no place in the others: values that do not
    fit the steady type (null there), those of a second field that came down to one column in the same object, and fields without a column.
    """
    below = len(table) + 1 if table else 0
    own = {c: t for c, t in types.items() if (c.startswith(table + ".") if table else True) and c not in apart}
    bare = set(own) - {c.rpartition(".")[0] for c in own}
    closed = {c for c, t in own.items() if t == "array" or (t == "object" and c in bare)}
    # what lies in an array has no column of its own
    hidden = lambda c: any(c[:i] in closed or c[:i] in apart for i, x in enumerate(c) if x == ".")
    steady = sorted((c, t) for c, t in own.items() if (t != "object" or c in closed) and not hidden(c))
    kinds = {"number": T.DoubleType(), "boolean": T.BooleanType()}
    names = carried([c[below:].replace(".", "_") for c, _ in steady] + ([rest] if rest else []), ["parent_path", "child_path"])
    kept = carried(carry, ["parent_path", "child_path", *names])
    source = df.select(*[F.col(c).alias(n) for c, n in zip(carry, kept, strict=True)], F.col(text).alias("__text"), F.col(moves).alias("__moves"))
    schema = T.StructType(
        [*source.schema.fields[: len(kept)], T.StructField("parent_path", T.StringType()), T.StructField("child_path", T.StringType())]
        + [T.StructField(n, kinds.get(t, T.StringType())) for n, (_, t) in zip(names, [*steady, *([("", "string")] if rest else [])], strict=True)]
    )
    arrow = to_arrow_schema(schema)
    width = len(steady) + 1  # the last cell holds the rest, asked for or not

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Table(table, types, apart, steady)
        for batch in batches:
            at: list[int] = []
            links: list[tuple[str | None, str]] = []
            cells: list[list] = []
            for i in range(batch.num_rows):

                def start(up: str, path: str, i=i, at=at, links=links, cells=cells) -> list:
                    at.append(i)
                    links.append((up or None, path))
                    cells.append([None] * width)
                    return cells[-1]

                _fill(batch["__text"][i].as_py(), known.router(batch["__moves"][i].as_py()).root, start)
            if at:
                taken = [batch[c].take(pa.array(at, pa.int64())) for c in kept]
                cols = [pa.array([x[j] for x in links], pa.string()) for j in (0, 1)]
                cols += [pa.array([r[j] for r in cells], arrow.field(len(kept) + 2 + j).type) for j in range(len(names))]
                yield pa.RecordBatch.from_arrays([*taken, *cols], schema=arrow)

    return source.mapInArrow(run, schema)


def routed_records(df: DataFrame, stream: str, file: str, schemas: DataFrame, routed: DataFrame) -> DataFrame:
    """``df`` with the column ``__moves``, the route of each record's file; null where every field stays where it is."""
    found, n, width = file_routes(schemas, routed)
    side = found.select(F.col("stream").alias("__stream"), F.col("file").alias("__file"), F.col("moves").alias("__moves"))
    on = F.col(stream).eqNullSafe(F.col("__stream")) & F.col(file).eqNullSafe(F.col("__file"))
    return df.join(broadcast_if_small(side, n, width), on, "left").drop("__stream", "__file")
