"""Every registered query of the core against its SQL, or against what must hold of it."""

import json

import numpy as np
import pytest

from tests.oracle import SF, compare
from tracewright.functions.lanes import with_lane
from tracewright.operators.spikes import REASONS, judge
from tracewright.plans.durable import load
from tracewright.queries import pipeline, repair

ALL = pipeline.QUERIES | repair.QUERIES
SQL = pipeline.ORACLE | repair.ORACLE


@pytest.mark.parametrize("name", list(SQL))
def test_query(spark, name):
    compare(spark, ALL[name], SQL[name])


def test_implausible_readings_are_those_of_each_lane(spark):
    lanes: dict[tuple, dict] = {}
    for r in with_lane(load(spark, SF, "trace_events")).where("dur IS NOT NULL").collect():
        lanes.setdefault((r["trace_id"], r["tid"]), {})[r["event_id"]] = (r["ts"], r["dur"], r["op"])
    want = {}
    for lane in lanes.values():
        rows = sorted(((ts is None, ts or 0.0, i, dur, op) for i, (ts, dur, op) in lane.items()))
        codes = {op: k for k, op in enumerate(sorted({r[4] for r in rows if r[4] is not None}))}
        why = judge(np.array([r[3] for r in rows], float), np.array([codes.get(r[4], -1) for r in rows]), np.array([not r[0] for r in rows]))
        want |= {r[2]: REASONS[w] for r, w in zip(rows, why.tolist(), strict=True) if w}
    assert {r["event_id"]: r["reason"] for r in ALL["p1_reasons"](spark, SF).collect()} == want
    assert {r["event_id"] for r in ALL["p1_found"](spark, SF).collect()} == set(want)


def _fields(v, path, out):
    if isinstance(v, dict):
        for k, x in v.items():
            if x is not None:
                at = f"{path}.{k}" if path else k
                kind = {dict: "object", list: "array", str: "string", bool: "boolean"}.get(type(x), "number")
                out.setdefault(at, {}).setdefault(kind, 0)
                out[at][kind] += 1
                _fields(x, at, out)
    elif isinstance(v, list):
        for x in v:
            if isinstance(x, (dict, list)):
                _fields(x, path, out)


def test_the_steps_of_a_file_lead_to_its_fields(spark):
    """Taken on the fields of the stream's previous existing file, they give those of the file; and they are the changes found."""
    files: dict[tuple, dict] = {}
    for r in load(spark, SF, "trace_json").dropDuplicates(["record_id"]).collect():
        out = files.setdefault((r["stream_id"], r["file_no"]), {})
        try:
            _fields(json.loads(r["payload"] or ""), "", out)
        except ValueError:
            pass
    types = {k: {p: min(t, key=lambda x: (-t[x], x)) for p, t in f.items()} for k, f in files.items()}
    steps: dict[tuple, list] = {}
    for r in ALL["p6_steps"](spark, SF).orderBy("stream_id", "file_no", "step").collect():
        steps.setdefault((r["stream_id"], r["file_no"]), []).append((r["action"], r["path"], r["target"]))
    below = lambda fields, p: {q for q in fields if q == p or q.startswith(p + ".")}
    changes = set()
    for stream, file in sorted(files):
        before = [f for s, f in files if s == stream and f < file]
        now = types[stream, file]
        if not before:
            assert (stream, file) not in steps
            continue
        have = dict(types[stream, max(before)])
        for action, p, target in steps.get((stream, file), []):
            gone = {q: have.pop(q) for q in below(have, p)}
            if action == "rename":
                assert now[target] == gone[p]
                have |= {q: now[q] for q in below(now, target)}
            elif action != "default":
                assert now[p] == target
                have |= {q: now[q] for q in below(now, p)}
            changes.add((stream, file, {"rename": "renamed", "cast": "retyped", "default": "removed", "add": "added"}[action], "" if action == "add" else p, {"rename": target, "default": ""}.get(action, p)))
        assert have == now
    assert {tuple(r) for r in ALL["p6_found"](spark, SF).select("stream_id", "file_no", "change_kind", "old_path", "new_path").collect()} == changes
    routed = {(r["stream_id"], r["version"], r["path"]) for r in ALL["p6_routes"](spark, SF).collect()}
    version = {(r["stream_id"], r["file_no"]): r["version"] for r in ALL["p6_versions"](spark, SF).collect()}
    assert routed == {(s, version[s, f], p) for (s, f), t in types.items() for p in t}


def test_every_query_is_tested():
    assert set(ALL) - set(SQL) == {"p1_found", "p1_reasons", "p2_tables", "p6_found", "p6_steps", "p6_routes", "p6_events", "p6_records"}  # the tables in test_json


def test_entry_has_all(spark):
    import __spark_entry__ as entry

    assert set(ALL) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
