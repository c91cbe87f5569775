"""Queries over dirty trace tables: spikes, nesting, intervals, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.lanes import valid_readings, with_lane
from tracewright.operators import drift, nested
from tracewright.operators.intervals import merge_intervals
from tracewright.operators.spikes import implausible
from tracewright.plans.durable import cut, load
from tracewright.plans.once import once

#: The SQL forms of a lane, an op and a valid reading, redelivered rows once.
READINGS_SQL = r"""
readings AS (
  SELECT DISTINCT event_id, trace_id, CAST(tid_text AS INT) AS tid, op, ts, dur FROM (
    SELECT event_id, trace_id, ts, dur,
           regexp_extract(tid, '^\s*([+-]?[0-9]+)\s*$', 1) AS tid_text,
           split_part(lower(regexp_replace(name, '^\s+|\s+$', '', 'g')), '-', 1) AS op
    FROM trace_events)
  WHERE tid_text <> '' AND TRY_CAST(tid_text AS INT) IS NOT NULL AND trace_id IS NOT NULL
    AND ts IS NOT NULL AND dur IS NOT NULL AND NOT isnan(ts) AND NOT isnan(dur) AND dur > 0 AND dur <= 10000000)
"""


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _implausible(spark, sf_dir).select("event_id")


def p1_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each of the events is implausible."""
    return _implausible(spark, sf_dir)


def _implausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = with_lane(load(spark, sf_dir, "trace_events"))
    return implausible(events, ["trace_id", "tid"], item="event_id", time="ts", value="dur", kind="op")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = valid_readings(load(spark, sf_dir, "trace_events"))
    ns = readings.select(
        "trace_id", "tid",
        F.round(F.col("ts") * 1000).cast("long").alias("start_ns"),
        F.round((F.col("ts") + F.col("dur")) * 1000).cast("long").alias("end_ns"),
    )
    return merge_intervals(ns, ["trace_id", "tid"], "start_ns", "end_ns")


P4_SQL = f"""
WITH {READINGS_SQL},
iv AS (SELECT trace_id, tid, CAST(round(ts * 1000) AS BIGINT) AS s, CAST(round((ts + dur) * 1000) AS BIGINT) AS e FROM readings),
reach AS (SELECT *, max(e) OVER (PARTITION BY trace_id, tid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM iv),
marked AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id, tid ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM reach),
busy AS (SELECT trace_id, tid, min(s) AS s, max(e) AS e FROM marked GROUP BY trace_id, tid, island)
SELECT trace_id, tid, 'busy' AS kind, s AS start_ns, e AS end_ns FROM busy
UNION ALL
SELECT trace_id, tid, 'gap', s, e FROM (
  SELECT trace_id, tid, e AS s, lead(s) OVER (PARTITION BY trace_id, tid ORDER BY s) AS e FROM busy) WHERE e IS NOT NULL
"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiler documents, redelivered rows once."""
    docs = load(spark, sf_dir, "trace_json").select("record_id", "stream_id", "file_no", "payload")
    return once(docs, "record_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of all rows of all flat tables but the records' roots."""
    return p2_tables(spark, sf_dir).where("table_path <> '$'").select("record_id", "parent_path", "child_path")


P2_SQL = """
WITH RECURSIVE docs AS (SELECT DISTINCT record_id, payload::JSON AS doc FROM trace_json WHERE json_valid(payload)),
node(record_id, path, item, parent, is_item, doc) AS (
  SELECT record_id, '', '$', '', false, doc FROM docs
  UNION ALL
  SELECT record_id, path2, CASE WHEN in_array AND json_type(child) = 'OBJECT' THEN path2 ELSE item END,
         CASE WHEN in_array AND json_type(child) = 'OBJECT' THEN item ELSE parent END,
         in_array AND json_type(child) = 'OBJECT', child FROM (
    SELECT record_id, item, parent, false AS in_array, CASE WHEN path = '' THEN k ELSE path || '.' || k END AS path2,
           json_extract(doc, '$."' || k || '"') AS child
    FROM (SELECT *, unnest(json_keys(doc)) AS k FROM node WHERE json_type(doc) = 'OBJECT')
    UNION ALL
    SELECT record_id, item, parent, true, path || '[' || i || ']', json_extract(doc, '$[' || i || ']')
    FROM (SELECT *, unnest(range(CAST(json_array_length(doc) AS BIGINT))) AS i FROM node WHERE json_type(doc) = 'ARRAY'))
  WHERE json_type(child) IN ('OBJECT', 'ARRAY'))
SELECT record_id, parent AS parent_path, path AS child_path FROM node WHERE is_item
"""


def p2_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All flat tables of all objects with all their fields, each row linked to its parent."""
    return nested.flat(_records(spark, sf_dir), "payload", ["record_id"])


def _table(spark: SparkSession, sf_dir: str, path: str, fields: list[str]) -> DataFrame:
    rows = nested.flat(_records(spark, sf_dir), "payload", ["record_id"], [path])
    return nested.table(rows, path, fields, ["record_id"])


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of distributedInfo.groups: one row per group, linked to its record."""
    return _table(spark, sf_dir, "distributedInfo.groups", ["gname", "ranks", "size"])


def p2_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest flat table: frames of calls of events, linked to their call."""
    return _table(spark, sf_dir, "traceEvents.args.calls.frames", ["f", "line"])


P2_FRAMES_SQL = """
WITH docs AS (SELECT DISTINCT record_id, payload::JSON AS doc FROM trace_json WHERE json_valid(payload)),
e AS (SELECT record_id, i, json_extract(doc, '$.traceEvents[' || i || ']') AS e
  FROM (SELECT *, unnest(range(CAST(json_array_length(doc, '$.traceEvents') AS BIGINT))) AS i FROM docs)),
c AS (SELECT record_id, i, j, json_extract(e, '$.args.calls[' || j || ']') AS c
  FROM (SELECT *, unnest(range(CAST(json_array_length(e, '$.args.calls') AS BIGINT))) AS j FROM e)),
f AS (SELECT record_id, i, j, k, json_extract(c, '$.frames[' || k || ']') AS f
  FROM (SELECT *, unnest(range(CAST(json_array_length(c, '$.frames') AS BIGINT))) AS k FROM c))
SELECT record_id, 'traceEvents[' || i || '].args.calls[' || j || '].frames[' || k || ']' AS child_path,
  'traceEvents[' || i || '].args.calls[' || j || ']' AS parent_path, json_extract_string(f, '$.f') AS f, json_extract_string(f, '$.line') AS line
FROM f WHERE json_type(f) = 'OBJECT'
"""

P2_GROUPS_SQL = """
WITH docs AS (SELECT DISTINCT record_id, payload::JSON AS doc FROM trace_json WHERE json_valid(payload)),
g AS (SELECT record_id, i, json_extract(doc, '$.distributedInfo.groups[' || i || ']') AS g
  FROM (SELECT *, unnest(range(CAST(json_array_length(doc, '$.distributedInfo.groups') AS BIGINT))) AS i FROM docs))
SELECT record_id, 'distributedInfo.groups[' || i || ']' AS child_path, '$' AS parent_path, json_extract_string(g, '$.gname') AS gname,
  CASE WHEN json_type(g, '$.ranks') = 'ARRAY' THEN CAST(json_extract(g, '$.ranks') AS VARCHAR) END AS ranks, json_extract_string(g, '$.size') AS "size"
FROM g WHERE json_type(g) = 'OBJECT'
"""


def _schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(drift.file_schemas(load(spark, sf_dir, "trace_json"), "payload", "stream_id", "file_no"))


def _named(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"stream": "stream_id", "file": "file_no"})


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each migration step changed."""
    steps = drift.migration_steps(drift.history(_schemas(spark, sf_dir)))
    return _named(drift.changes(steps))


def p6_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's schema version within its stream."""
    return _named(drift.versions(_schemas(spark, sf_dir)))


def p6_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The migration steps of each version of each stream."""
    return _named(drift.migration_steps(drift.history(_schemas(spark, sf_dir))))


def p6_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steady place of each field of each version of each stream."""
    return _named(drift.routes(cut(drift.history(_schemas(spark, sf_dir)))))


def p6_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All traceEvents of all files in one table with steady columns and types."""
    return _steady(spark, sf_dir, "traceEvents")


def p6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """distributedInfo and the other fields of the documents in one table with steady columns and types, one row per record."""
    return _steady(spark, sf_dir, "", ("traceEvents",))


def _steady(spark: SparkSession, sf_dir: str, table: str, apart: tuple[str, ...] = ()) -> DataFrame:
    schemas = _schemas(spark, sf_dir)
    routed = cut(drift.routes(cut(drift.history(schemas))))
    records = drift.routed_records(_records(spark, sf_dir), "stream_id", "file_no", schemas, routed)
    return drift.steady_table(records, "payload", ["record_id", "stream_id", "file_no"], "__moves", drift.steady_columns(routed), table, "rest", apart)


#: Fields with their types, per file; then each file's fingerprint against the previous one's.
P6_VERSIONS_SQL = """
WITH RECURSIVE docs AS (SELECT DISTINCT stream_id, file_no, payload::JSON AS doc FROM trace_json WHERE json_valid(payload)),
node(stream_id, file_no, path, kind, doc) AS (
  SELECT stream_id, file_no, '', 'OBJECT', doc FROM docs
  UNION ALL
  SELECT stream_id, file_no, path2, json_type(child), child FROM (
    SELECT stream_id, file_no, CASE WHEN path = '' THEN k ELSE path || '.' || k END AS path2, json_extract(doc, '$."' || k || '"') AS child
    FROM (SELECT *, unnest(json_keys(doc)) AS k FROM node WHERE json_type(doc) = 'OBJECT')
    UNION ALL
    SELECT stream_id, file_no, path, json_extract(doc, '$[' || i || ']')
    FROM (SELECT *, unnest(range(CAST(json_array_length(doc) AS BIGINT))) AS i FROM node WHERE json_type(doc) = 'ARRAY'))
  WHERE json_type(child) <> 'NULL'),
field AS (SELECT DISTINCT stream_id, file_no, path2 AS path, CASE json_type(child) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string'
    WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS type
  FROM (SELECT stream_id, file_no, CASE WHEN path = '' THEN k ELSE path || '.' || k END AS path2, json_extract(doc, '$."' || k || '"') AS child
    FROM (SELECT *, unnest(json_keys(doc)) AS k FROM node WHERE json_type(doc) = 'OBJECT')) WHERE json_type(child) <> 'NULL'),
prints AS (SELECT f.stream_id, f.file_no, md5(coalesce(p, '')) AS fingerprint FROM (SELECT DISTINCT stream_id, file_no FROM trace_json) f
  LEFT JOIN (SELECT stream_id, file_no, string_agg(path || ':' || type, ',' ORDER BY path, type) AS p FROM field GROUP BY 1, 2) g USING (stream_id, file_no)),
fresh AS (SELECT *, fingerprint IS DISTINCT FROM lag(fingerprint) OVER (PARTITION BY stream_id ORDER BY file_no) AS f FROM prints)
SELECT stream_id, file_no, CAST(sum(CAST(f AS INT)) OVER (PARTITION BY stream_id ORDER BY file_no) AS INT) AS version, fingerprint FROM fresh
"""


QUERIES = {
    "p1_found": p1_found,
    "p1_reasons": p1_reasons,
    "p2_found": p2_found,
    "p2_tables": p2_tables,
    "p2_groups": p2_groups,
    "p2_frames": p2_frames,
    "p4_found": p4_found,
    "p6_found": p6_found,
    "p6_versions": p6_versions,
    "p6_steps": p6_steps,
    "p6_routes": p6_routes,
    "p6_events": p6_events,
    "p6_records": p6_records,
}
ORACLE = {"p6_versions": P6_VERSIONS_SQL, "p2_found": P2_SQL, "p2_groups": P2_GROUPS_SQL, "p2_frames": P2_FRAMES_SQL, "p4_found": P4_SQL}
