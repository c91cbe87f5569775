"""Queries of the training-data operators and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.lanes import valid_readings
from tracewright.llm.mixing import mix
from tracewright.llm.percentiles import percentiles, roll_up, summarize
from tracewright.llm.spans import shared_share, shared_spans
from tracewright.llm.tokens import decode_column, encode_column
from tracewright.llm.topn import top_n_per_group
from tracewright.plans.durable import cut, load
from tracewright.plans.once import marked_repeats
from tracewright.queries.repair import READINGS_SQL

LANE_OP = ["trace_id", "tid", "op"]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = valid_readings(load(spark, sf_dir, "trace_events")).where(F.col("op").isNotNull())
    best = top_n_per_group(readings, LANE_OP, [("dur", True), ("ts", False), ("event_id", False)], 3)
    return best.select(*LANE_OP, F.col("place").cast("int").alias("place"), "event_id")


P3_SQL = f"""
WITH {READINGS_SQL}
SELECT trace_id, tid, op, CAST(place AS INT) AS place, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY trace_id, tid, op ORDER BY dur DESC, ts, event_id) AS place
  FROM readings WHERE op IS NOT NULL) WHERE place <= 3
"""


def _readings(spark: SparkSession, sf_dir: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Valid readings with an op; ``again`` marks redelivered ones."""
    events = marked_repeats(load(spark, sf_dir, "trace_events"), "event_id", "again")
    return valid_readings(events, ["again", *more]).where(F.col("op").isNotNull())


def _p5(spark: SparkSession, sf_dir: str, qs: list[float], at_least: int = 1) -> DataFrame:
    return percentiles(summarize(_readings(spark, sf_dir), LANE_OP, "dur", again="again"), qs, at_least)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of at least 100 readings whose 95th percentile is three medians or more."""
    by_q = lambda q: F.max(F.when(F.col("q") == q, F.col("value")))
    return (
        _p5(spark, sf_dir, [0.5, 0.95], 100)
        .groupBy(*LANE_OP)
        .agg(by_q(0.5).alias("p50"), by_q(0.95).alias("p95"))
        .where(F.col("p95") >= 3 * F.col("p50"))
        .select(*LANE_OP)
    )


def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p5(spark, sf_dir, [0.05, 0.25, 0.5, 0.75, 0.95, 0.99])


def p5_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from kept summaries of separate days, combined."""
    days = _readings(spark, sf_dir, ("captured_at",)).withColumn("day", F.to_date("captured_at"))
    by_day = summarize(days, [*LANE_OP, "day"], "dur", again="again").compact()
    return percentiles(roll_up(by_day, LANE_OP), [0.05, 0.25, 0.5, 0.75, 0.95, 0.99])


_RANKED = f"""
WITH {READINGS_SQL},
ranked AS (SELECT trace_id, tid, op, dur, row_number() OVER (PARTITION BY trace_id, tid, op ORDER BY dur) AS r,
                  count(*) OVER (PARTITION BY trace_id, tid, op) AS n FROM readings WHERE op IS NOT NULL)
"""
P5_SQL = f"""{_RANKED}
SELECT trace_id, tid, op FROM ranked GROUP BY trace_id, tid, op
HAVING max(n) >= 100 AND max(CASE WHEN r = ceil(0.95 * n) THEN dur END) >= 3 * max(CASE WHEN r = ceil(0.5 * n) THEN dur END)
"""
P5_ALL_SQL = f"""{_RANKED}
SELECT trace_id, tid, op, CAST(q AS DOUBLE) AS q, CAST(n AS BIGINT) AS n_readings, dur AS value
FROM ranked, (VALUES (0.05), (0.25), (0.5), (0.75), (0.95), (0.99)) t(q) WHERE r = ceil(q * n)
"""


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_column(load(spark, sf_dir, "documents"), "text", ["doc_id"])


def p7_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, encoded and decoded again."""
    return decode_column(p7_ids(spark, sf_dir), "ids", ["doc_id"])


P7_ROUNDTRIP_SQL = "SELECT doc_id, coalesce(text, '') AS text FROM documents"


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sized = cut(encode_column(load(spark, sf_dir, "documents"), "text", ["doc_id", "source"], counts_only=True))
    return mix(sized, load(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1].where("short").select("source")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents with their repeats."""
    return _mixed(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source."""
    return _mixed(spark, sf_dir)[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(load(spark, sf_dir, "documents"), "doc_id", "text")


_SHARED = """
WITH w AS (SELECT DISTINCT doc_id, i, substr(text, i + 1, 150) AS piece FROM (
  SELECT doc_id, text, unnest(range(CAST(length(text) - 149 AS BIGINT))) AS i FROM documents WHERE length(text) >= 150)),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w
  WHERE piece IN (SELECT piece FROM w GROUP BY piece HAVING min(doc_id) < max(doc_id))),
runs AS (SELECT *, sum(CASE WHEN before IS NULL OR i > before + 150 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hit),
spans AS (SELECT doc_id, CAST(min(i) AS INT) AS span_start, CAST(max(i) + 150 AS INT) AS span_end FROM runs GROUP BY doc_id, k)
"""
P9_SQL = f"{_SHARED} SELECT * FROM spans"
P9_SHARES_SQL = f"""{_SHARED}
SELECT d.doc_id, CAST(coalesce(length(text), 0) AS INT) AS n_chars, CAST(coalesce(s, 0) AS BIGINT) AS shared_chars,
  CASE WHEN length(text) > 0 THEN coalesce(s, 0)::DOUBLE / length(text) ELSE 0.0::DOUBLE END AS shared_share
FROM documents d LEFT JOIN (SELECT doc_id, sum(span_end - span_start) AS s FROM spans GROUP BY 1) c ON c.doc_id = d.doc_id
"""


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document is shared elsewhere."""
    docs = load(spark, sf_dir, "documents")
    return shared_share(docs, "doc_id", "text", shared_spans(docs, "doc_id", "text"))


QUERIES = {
    "p3_found": p3_found,
    "p5_found": p5_found,
    "p5_percentiles": p5_percentiles,
    "p5_days": p5_days,
    "p7_ids": p7_ids,
    "p7_roundtrip": p7_roundtrip,
    "p8_found": p8_found,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_shares": p9_shares,
}
ORACLE = {"p9_found": P9_SQL, "p9_shares": P9_SHARES_SQL, "p3_found": P3_SQL, "p5_found": P5_SQL, "p5_percentiles": P5_ALL_SQL, "p5_days": P5_ALL_SQL, "p7_roundtrip": P7_ROUNDTRIP_SQL}
