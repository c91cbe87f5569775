"""Queries over schedules, task graphs, simulation, metrics, layout and profiler documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.lanes import lane_tid
from tracewright.model import EDGE_COLS, EVENT_TYPES, KEY_COLS, NODE_COLS, SCHEDULES, cost_is_valid, event_type_is_known, partition_is_valid
from tracewright.operators import graph, layout, metrics, steps, trace
from tracewright.operators.graph import PipelineGraph, merge_graphs
from tracewright.operators.schedules import config_frame, config_is_sound, graph_edges, graph_nodes
from tracewright.operators.simulate import simulate, simulate_configs, simulate_waves, unreached
from tracewright.plans.durable import cut, load, new_path
from tracewright.plans.flow import FlowGraph, FlowNode
from tracewright.queries import pipeline_sql as sql
from tracewright.sources import svg
from tracewright.sources.profiler import DOC_SCHEMA, ProfilerJson, ProfilerTable, classify, events_of
from tracewright.streaming.utilisation import device_load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

LOW, HIGH = [0, 1], list(range(2, 64))


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return put


def _configs(spark: SparkSession, sf_dir: str, schedule: str | None = None) -> DataFrame:
    c = load(spark, sf_dir, "config")
    return c.where(F.col("schedule") == schedule) if schedule else c


def _sound(spark: SparkSession, sf_dir: str, schedule: str | None) -> DataFrame:
    return _configs(spark, sf_dir, schedule).where(config_is_sound())


def _sim(configs: DataFrame, schedule: str) -> DataFrame:
    return simulate(graph_nodes(configs), graph_edges(configs, [schedule]))


# ---------------------------------------------------------------- configurations


@query(
    "cost_config_validate",
    "SELECT graph_id, (fwd_time IS NOT NULL AND bwd_time IS NOT NULL AND wgt_time IS NOT NULL) AS valid FROM config",
)
def cost_config_validate(spark, sf):
    return _configs(spark, sf).select("graph_id", cost_is_valid(F.col("fwd_time"), F.col("bwd_time"), F.col("wgt_time")).alias("valid"))


_MEMORY = ("CAST(nchunks AS DOUBLE)", "-1.0::DOUBLE", "CASE WHEN nstages % 2 = 0 THEN 1.0::DOUBLE - nchunks ELSE -1.0::DOUBLE END")


@query(
    "cost_values_validate",
    f"""SELECT graph_id, coalesce(fwd_time / 2.0::DOUBLE = floor(fwd_time / 2.0::DOUBLE) AND bwd_time IS NOT NULL AND wgt_time IS NOT NULL AND {" + ".join(_MEMORY)} = 0, false) AS valid FROM config""",
)
def cost_values_validate(spark, sf):
    """Whole times and memory that is given back: half of the forward cost, one chunk's memory taken per chunk."""
    memory = (F.col("nchunks").cast("double"), F.lit(-1.0), F.when(F.col("nstages") % 2 == 0, F.lit(1.0) - F.col("nchunks")).otherwise(-1.0))
    return _configs(spark, sf).select("graph_id", cost_is_valid(F.col("fwd_time") / F.lit(2.0), F.col("bwd_time"), F.col("wgt_time"), memory).alias("valid"))


@query(
    "config_checked",
    """SELECT graph_id, fwd_time IS NOT NULL AND bwd_time IS NOT NULL AND (nchunks = 1 OR schedule NOT IN ('gpipe', 'pipedream')) AND (schedule <> 'zbv' OR nchunks % 2 = 0) AS accepted
    FROM config""",
)
def config_checked(spark, sf):
    """The checks that a configuration given by hand goes through, each row of the fixed table in its turn."""

    def accepted(row) -> bool:
        try:
            config_frame(spark, [row.asDict()])
        except (ValueError, AssertionError):
            return False
        return True

    return spark.createDataFrame([(r["graph_id"], accepted(r)) for r in _configs(spark, sf).collect()], "graph_id string, accepted boolean")


@query("config_sound", f"SELECT graph_id, ({sql.SOUND}) AS sound FROM config")
def config_sound(spark, sf):
    return _configs(spark, sf).select("graph_id", config_is_sound().alias("sound"))


@query(
    "partition_plan_validate",
    """SELECT graph_id, CAST(nstages AS INT) AS nstages, abs(list_sum(list_transform(range(0, nstages), lambda i: (i + 1) / 10.0)) - 1) <= 1e-9 AS valid FROM config""",
)
def partition_plan_validate(spark, sf):
    plan = F.transform(F.sequence(F.lit(0), F.col("nstages") - 1), lambda i: (i + 1) / F.lit(10.0))
    return _configs(spark, sf).select("graph_id", "nstages", partition_is_valid(F.col("nstages"), plan).alias("valid"))


# ---------------------------------------------------------------- generators

for _name, _where in (("graph_nodes_fb", "schedule NOT IN ('zb', 'zbv')"), ("graph_nodes_fbw", "schedule IN ('zb', 'zbv')")):

    @query(_name, f"WITH {sql.configs(_where)},{sql.NODES} SELECT * FROM n")
    def _nodes(spark, sf, where=_where):
        return graph_nodes(_configs(spark, sf).where(where))


def _edge_query(name: str, schedule: str, where: str) -> None:
    @query(name, f"WITH {sql.configs(f'schedule = {schedule!r} AND {sql.SOUND} AND {where}')},{sql.NODES},\n{sql.edges(schedule)} SELECT * FROM ed")
    def _edges(spark, sf):
        return graph_edges(_sound(spark, sf, schedule).where(where), [schedule])


for _n, _s, _w in (
    ("graph_edges_gpipe", "gpipe", "TRUE"),
    ("graph_edges_pipedream", "pipedream", "NOT eager"),
    ("graph_edges_pipedream_eager", "pipedream", "eager"),
    ("graph_edges_interleaved", "interleaved", "TRUE"),
    ("graph_edges_zb", "zb", "TRUE"),
    ("graph_edges_zbv", "zbv", "TRUE"),
):
    _edge_query(_n, _s, _w)

# ---------------------------------------------------------------- graphs at rest (dirty tables)

_CLEAN = f"""
n AS (SELECT {", ".join(NODE_COLS)} FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, {", ".join(KEY_COLS)} ORDER BY event_num DESC, dur DESC NULLS LAST) AS r FROM nodes) WHERE r = 1),
ed AS (SELECT DISTINCT * FROM edges)"""
_MATCH = {
    s: " AND ".join(f"n.{k} = ed.{c}" for k, c in zip(["graph_id", *KEY_COLS], ["graph_id", *cols], strict=True))
    for s, cols in (("src", EDGE_COLS[1:5]), ("dst", EDGE_COLS[5:]))
}


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return graph.clean_nodes(load(spark, sf_dir, "nodes")), graph.clean_edges(load(spark, sf_dir, "edges"))


@query("graph_clean_nodes", f"WITH {_CLEAN} SELECT * FROM n")
def graph_clean_nodes(spark, sf):
    return _tables(spark, sf)[0]


@query(
    "graph_check_dangling",
    f"WITH {_CLEAN} SELECT * FROM ed WHERE NOT EXISTS (SELECT 1 FROM n WHERE {_MATCH['src']}) OR NOT EXISTS (SELECT 1 FROM n WHERE {_MATCH['dst']})",
)
def graph_check_dangling(spark, sf):
    return graph.dangling_edges(*_tables(spark, sf))


@query(
    "graph_in_degree",
    f"""WITH {_CLEAN} SELECT n.graph_id, n.event_num, CAST(count(x.dst_type) AS BIGINT) AS in_degree FROM n LEFT JOIN
    (SELECT ed.* FROM ed WHERE EXISTS (SELECT 1 FROM n WHERE {_MATCH['src']})) AS x
    ON {_MATCH['dst'].replace('ed.', 'x.')} GROUP BY n.graph_id, n.event_num""",
)
def graph_in_degree(spark, sf):
    return graph.in_degree(*_tables(spark, sf))


@query("graph_sources", f"WITH {_CLEAN} SELECT n.* FROM n WHERE NOT EXISTS (SELECT 1 FROM ed WHERE {_MATCH['dst']})")
def graph_sources(spark, sf):
    return graph.sources(*_tables(spark, sf))


@query("graph_filter_nodes", f"WITH {_CLEAN} SELECT * FROM n WHERE stage_id IN (2, 3)")
def graph_filter_nodes(spark, sf):
    return PipelineGraph.custom(load(spark, sf, "nodes"), load(spark, sf, "edges")).filter([2, 3]).nodes


@query("graph_filter_edges", f"WITH {_CLEAN} SELECT * FROM ed WHERE src_stage IN (2, 3) AND dst_stage IN (2, 3)")
def graph_filter_edges(spark, sf):
    return PipelineGraph.custom(load(spark, sf, "nodes"), load(spark, sf, "edges")).filter([2, 3]).edges


@query("graph_crossing_edges", f"WITH {_CLEAN} SELECT * FROM ed WHERE (src_stage <= 1) <> (dst_stage <= 1)")
def graph_crossing_edges(spark, sf):
    return graph.crossing_edges(_tables(spark, sf)[1], LOW)


_CUT_CAST = ", ".join(f"CAST({c} AS {'VARCHAR' if 'type' in c or c == 'graph_id' else 'INT'}) AS {c}" for c in EDGE_COLS)


@query("graph_cut_edges", f"WITH {sql.configs()},{sql.cut_edges_sql(2)} SELECT {_CUT_CAST} FROM cutted")
def graph_cut_edges(spark, sf):
    return graph.cut_edges(_configs(spark, sf), 2)


def _hetero(configs: DataFrame, schedule: str) -> PipelineGraph:
    """Low stages at the configured costs, high stages with forward and backward costs exchanged, and the cut edges."""
    wide = configs.where("nstages > 2")
    other = wide.withColumns({"fwd_time": F.col("bwd_time"), "bwd_time": F.col("fwd_time")})
    parts = [PipelineGraph.of(wide, schedule).filter(LOW), PipelineGraph.of(other, schedule).filter(HIGH)]
    return merge_graphs(None, parts, graph.cut_edges(wide, 2))


def _hetero_sql(schedule: str, table: str = "config") -> str:
    swap = "CASE WHEN stage_id < 2 THEN dur ELSE CASE event_type WHEN 'FWD' THEN b WHEN 'BWD' THEN f ELSE dur END END AS dur"
    nodes = sql.NODES.replace("\nn AS (", "\nn0 AS (")
    edges = sql.edges(schedule).replace("\ned AS (", "\ned0 AS (")
    return f"""WITH RECURSIVE {sql.configs(f'schedule = {schedule!r} AND {sql.SOUND} AND nstages > 2', table)},{nodes},
n AS (SELECT n0.* EXCLUDE (dur), {swap} FROM n0 JOIN (SELECT graph_id, fwd_time AS f, bwd_time AS b FROM cfg) USING (graph_id)),
{edges},{sql.cut_edges_sql(2)},
ed AS (SELECT * FROM ed0 WHERE (src_stage < 2) = (dst_stage < 2) UNION SELECT {_CUT_CAST} FROM cutted)"""


@query("graph_merge_nodes", f"{_hetero_sql('zb')} SELECT * FROM n")
def graph_merge_nodes(spark, sf):
    return _hetero(_sound(spark, sf, "zb"), "zb").nodes


@query("graph_merge_edges", f"{_hetero_sql('zb')} SELECT * FROM ed")
def graph_merge_edges(spark, sf):
    return _hetero(_sound(spark, sf, "zb"), "zb").edges


_KEY0 = "event_type = 'FWD' AND stage_id = 0 AND microbatch_id = 0 AND chunk_id = 0"


@query(
    "graph_add_node",
    f"""WITH {_CLEAN}, mx AS (SELECT graph_id, max(event_num) AS l FROM n GROUP BY 1)
    SELECT * FROM n WHERE NOT ({_KEY0})
    UNION ALL SELECT graph_id, l + 1, 'FWD', 0, 0, 0, 'F:0-0', -1, 5 FROM mx UNION ALL SELECT graph_id, l + 2, 'WGT', 0, 0, 9, 'W:0-9', -1, 77 FROM mx""",
)
def graph_add_node(spark, sf):
    """A node of a known key takes the old one's place, one of a new key is added; the number moves on."""
    g = PipelineGraph.custom(load(spark, sf, "nodes"), load(spark, sf, "edges"))
    return g.add_node("FWD", 0, 0, 5).add_node("WGT", 0, 0, 77, 9).nodes


# ---------------------------------------------------------------- simulation


def _sim_query(name: str, schedule: str, where: str = "TRUE") -> None:
    @query(name, f"{sql.simulated(schedule, where)} SELECT * FROM tr")
    def _run(spark, sf):
        return _sim(_sound(spark, sf, schedule).where(where), schedule)


def _hetero_query(name: str, schedule: str) -> None:
    @query(name, f"{_hetero_sql(schedule)},{sql.SIMULATE} SELECT * FROM tr")
    def _run(spark, sf):
        return steps.PipelineSimulator().run(_hetero(_sound(spark, sf, schedule), schedule))


for _n, _s, _w in (
    ("sim_gpipe", "gpipe", "TRUE"),
    ("sim_pipedream", "pipedream", "NOT eager"),
    ("sim_pipedream_eager", "pipedream", "eager"),
    ("sim_interleaved", "interleaved", "TRUE"),
    ("sim_zb", "zb", "TRUE"),
    ("sim_zbv", "zbv", "TRUE"),
):
    _sim_query(_n, _s, _w)
for _s in ("gpipe", "pipedream", "interleaved", "zb", "zbv"):
    _hetero_query(f"sim_hetero_{_s}", _s)


@query(
    "sim_filtered_no_cut",
    sql.simulated("zb").replace("FROM n),", "FROM n WHERE stage_id >= 1),") + " SELECT * FROM tr",
)
def sim_filtered_no_cut(spark, sf):
    """Nodes that lost all predecessors start at 0, whatever their stage is doing."""
    c = _sound(spark, sf, "zb")
    keep = list(range(1, 64))
    return simulate(graph.filter_nodes(graph_nodes(c), keep), graph.filter_edges(graph_edges(c, ["zb"]), keep))


@query("sim_tables", f"WITH RECURSIVE {_CLEAN},{sql.SIMULATE} SELECT * FROM tr")
def sim_tables(spark, sf):
    """The graphs at rest, repeated rows and null durations included."""
    return simulate(load(spark, sf, "nodes"), load(spark, sf, "edges"))


@query("sim_custom", f"WITH RECURSIVE {_CLEAN},{sql.SIMULATE} SELECT * FROM tr")
def sim_custom(spark, sf):
    """The same as graphs of a kind of their own, through the simulator object."""
    g = PipelineGraph.custom(load(spark, sf, "nodes"), load(spark, sf, "edges"))
    g.check()
    return steps.simulator("pp").run(g)


@query(
    "sim_unreached",
    f"""WITH RECURSIVE {sql.configs(f"schedule = 'gpipe' AND {sql.SOUND} AND nstages > 2")},{sql.NODES},
{sql.edges("gpipe")},
    looped AS (SELECT * FROM ed UNION SELECT graph_id, 'FWD', CAST(nstages - 1 AS INT), 0, 0, 'FWD', 1, 0, 0 FROM cfg),
    behind(g, t, s, m, c) AS (SELECT graph_id, 'FWD', 1, 0, 0 FROM cfg
      UNION SELECT g, dst_type, dst_stage, dst_mb, dst_chk FROM behind JOIN looped ON g = graph_id AND t = src_type AND s = src_stage AND m = src_mb AND c = src_chk)
    SELECT n.* FROM n JOIN behind ON g = graph_id AND t = event_type AND s = stage_id AND m = microbatch_id AND c = chunk_id""",
)
def sim_unreached(spark, sf):
    """Nodes on or behind a cycle: the last stage's first forward step waits for nothing but is waited for by the second stage's."""
    c = _sound(spark, sf, "gpipe").where("nstages > 2")
    at = lambda kind, stage, side: [F.lit(kind).alias(f"{side}_type"), stage.cast("int").alias(f"{side}_stage"), F.lit(0).alias(f"{side}_mb"), F.lit(0).alias(f"{side}_chk")]
    g = PipelineGraph.of(c, "gpipe").add_edges(c.select("graph_id", *at("FWD", F.col("nstages") - 1, "src"), *at("FWD", F.lit(1), "dst")))
    return unreached(g.nodes, steps.PipelineSimulator().run(g))


@query(
    "sim_perf",
    """SELECT 'g' AS trace_id, CAST(13 * (5478 + 5806) AS BIGINT) AS makespan, CAST(40 * (5478 + 5806) AS BIGINT) AS busy, 1 - 40.0::DOUBLE / (4 * 13) AS bubble_ratio""",
)
def sim_perf(spark, sf):
    """What the simulator tells of its last run: four stages, ten microbatches."""
    sim = steps.simulator("pp")
    sim.run(PipelineGraph.build(spark, "g", "gpipe", 4, 10, fwd_time=5478, bwd_time=5806, wgt_time=3534))
    perf = sim.perf()
    return spark.createDataFrame([tuple(perf[c] for c in ("trace_id", "makespan", "busy", "bubble_ratio"))], "trace_id string, makespan long, busy long, bubble_ratio double")


@query("sim_waves", f"{sql.simulated('gpipe')} SELECT * FROM tr")
def sim_waves(spark, sf):
    """The relational simulator for graphs beyond one task."""
    c = _sound(spark, sf, "gpipe")
    return simulate_waves(graph_nodes(c), graph_edges(c, ["gpipe"]))


def _sweep_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.floor("l_quantity").cast("long")
    odd = F.col("l_linenumber") % 2 == 1
    costs = load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        (F.sum(F.when(odd, q).otherwise(0)) + 1).alias("fwd_time"), (F.sum(F.when(odd, 0).otherwise(q)) + 1).alias("bwd_time")
    )
    return costs.select(
        F.concat(F.lit("s"), "l_suppkey").alias("graph_id"), F.lit("gpipe").alias("schedule"), F.lit(4).alias("nstages"), F.lit(8).alias("nmicrobatches"),
        F.lit(1).alias("nchunks"), "fwd_time", "bwd_time", F.lit(1).cast("long").alias("wgt_time"), F.lit(False).alias("eager"),
    )


@query(
    "sim_scenario_sweep",
    """WITH c AS (SELECT l_suppkey, CAST(sum(CASE WHEN l_linenumber % 2 = 1 THEN floor(l_quantity) ELSE 0 END) + 1 AS BIGINT) AS f,
      CAST(sum(CASE WHEN l_linenumber % 2 = 0 THEN floor(l_quantity) ELSE 0 END) + 1 AS BIGINT) AS b FROM lineitem GROUP BY 1)
    SELECT 's' || l_suppkey AS trace_id, 11 * (f + b) AS makespan FROM c""",
)
def sim_scenario_sweep(spark, sf):
    """One scenario per supplier, all simulated in one job."""
    return metrics.makespan(simulate_configs(_sweep_configs(spark, sf)))


@query("sim_configs", f"{sql.simulated('zbv')} SELECT * FROM tr")
def sim_configs(spark, sf):
    """Traces of a sweep, by shape."""
    return simulate_configs(_sound(spark, sf, "zbv"))


# ---------------------------------------------------------------- metrics and traces


@query("metrics_makespan", f"{sql.simulated('zb')} SELECT trace_id, CAST(max(ts + dur) AS BIGINT) AS makespan FROM tr GROUP BY 1")
def metrics_makespan(spark, sf):
    return metrics.makespan(_sim(_sound(spark, sf, "zb"), "zb"))


@query(
    "metrics_stage_busy",
    f"{sql.simulated('zbv')} SELECT trace_id, dev_id, CAST(sum(dur) AS BIGINT) AS busy, count(*) AS n_events, min(ts) AS first_ts, max(ts + dur) AS last_end FROM tr GROUP BY 1, 2",
)
def metrics_stage_busy(spark, sf):
    return metrics.stage_busy(_sim(_sound(spark, sf, "zbv"), "zbv"))


@query(
    "metrics_bubble",
    f"""{sql.simulated('interleaved')} SELECT trace_id, max(ts + dur) AS makespan, CAST(sum(dur) AS BIGINT) AS busy,
    1 - CAST(sum(dur) AS BIGINT) / (any_value(nstages)::BIGINT * max(ts + dur)) AS bubble_ratio FROM tr JOIN cfg ON cfg.graph_id = trace_id GROUP BY 1""",
)
def metrics_bubble(spark, sf):
    c = _sound(spark, sf, "interleaved")
    return metrics.bubble(_sim(c, "interleaved"), c.select(F.col("graph_id").alias("trace_id"), "nstages"))


@query(
    "metrics_idle_gaps",
    f"""{sql.simulated('pipedream')} SELECT trace_id, dev_id, seq, gap_start, ts AS gap_end, ts - gap_start AS idle FROM (
    SELECT *, coalesce(lag(ts + dur) OVER (PARTITION BY trace_id, dev_id ORDER BY seq), 0) AS gap_start FROM tr) WHERE ts > gap_start""",
)
def metrics_idle_gaps(spark, sf):
    return metrics.idle_gaps(_sim(_sound(spark, sf, "pipedream"), "pipedream"))


@query("metrics_phase_times", f"{sql.simulated('zb')} SELECT trace_id, event_type, CAST(sum(dur) AS BIGINT) AS total, min(ts) AS first_ts, max(ts + dur) AS last_end FROM tr GROUP BY 1, 2")
def metrics_phase_times(spark, sf):
    return metrics.phase_times(_sim(_sound(spark, sf, "zb"), "zb"))


@query(
    "metrics_critical_path",
    f"""{sql.simulated('gpipe')},
    tt AS (SELECT tr.*, ts + dur AS e FROM tr),
    lk AS (SELECT x.graph_id AS g, x.event_num AS a, y.event_num AS b FROM ee JOIN nn x ON x.k = ee.a JOIN nn y ON y.k = ee.b
      UNION SELECT trace_id, lag(event_num) OVER (PARTITION BY trace_id, dev_id ORDER BY seq), event_num FROM tt),
    st AS (SELECT lk.g, lk.b, min(lk.a) AS a FROM lk JOIN tt p ON p.trace_id = lk.g AND p.event_num = lk.a JOIN tt q ON q.trace_id = lk.g AND q.event_num = lk.b
      WHERE q.ts > 0 AND p.e = q.ts GROUP BY 1, 2),
    cp(g, n, back) AS (
      SELECT trace_id, arg_min(event_num, (-e, event_num)), 0 FROM tt GROUP BY 1
      UNION ALL SELECT cp.g, st.a, back + 1 FROM cp JOIN st ON st.g = cp.g AND st.b = cp.n)
    SELECT g AS trace_id, CAST(max(back) OVER (PARTITION BY g) - back AS BIGINT) AS step, event_num, ts, dur FROM cp JOIN tt ON trace_id = g AND event_num = n""",
)
def metrics_critical_path(spark, sf):
    c = _sound(spark, sf, "gpipe")
    nodes, edges = graph_nodes(c), graph_edges(c, ["gpipe"])
    return metrics.critical_path(simulate(nodes, edges), graph.numbered_edges(nodes, edges))


@query(
    "trace_comm_events",
    """SELECT trace_id, dev_id, seq, event_num, 'COMM' AS event_type, name, ts, dur, dev_id AS src_dev_id, dst_dev_id FROM (
    SELECT DISTINCT trace_id, TRY_CAST(regexp_extract(tid, '^\\s*([+-]?[0-9]+)\\s*$', 1) AS INT) AS dev_id, seq, event_id AS event_num, name, ts, dur,
      TRY_CAST(regexp_extract(tid, '^\\s*([+-]?[0-9]+)\\s*$', 1) AS INT) + 1 AS dst_dev_id FROM trace_events WHERE event_type = 'COMM') WHERE dev_id IS NOT NULL""",
)
def trace_comm_events(spark, sf):
    """Transfers to the next device."""
    e = load(spark, sf, "trace_events").where("event_type = 'COMM'").select("trace_id", "seq", F.col("event_id").alias("event_num"), "name", "ts", "dur", lane_tid(F.col("tid")).alias("src_dev_id"))
    return trace.comm_events(e.where("src_dev_id IS NOT NULL").distinct().withColumn("dst_dev_id", F.col("src_dev_id") + 1))


@query("trace_device_events", f"{sql.simulated('gpipe')} SELECT * FROM tr WHERE dev_id = 1")
def trace_device_events(spark, sf):
    return trace.device_events(_sim(_sound(spark, sf, "gpipe"), "gpipe"), 1)


@query(
    "trace_device_counts",
    """WITH t AS (SELECT DISTINCT trace_id, ndevs FROM trace_meta WHERE ndevs IS NOT NULL),
    e AS (SELECT DISTINCT event_id, trace_id, TRY_CAST(regexp_extract(tid, '^\\s*([+-]?[0-9]+)\\s*$', 1) AS INT) AS dev_id FROM trace_events)
    SELECT t.trace_id, CAST(d.d AS INT) AS dev_id, CAST(count(e.event_id) AS BIGINT) AS n_events FROM t JOIN range(0, 100000) d(d) ON d.d < t.ndevs
    LEFT JOIN e ON e.trace_id = t.trace_id AND e.dev_id = d.d GROUP BY 1, 2""",
)
def trace_device_counts(spark, sf):
    sizes = load(spark, sf, "trace_meta").where("ndevs > 0").select("trace_id", "ndevs").distinct()
    events = load(spark, sf, "trace_events").select("event_id", "trace_id", lane_tid(F.col("tid")).alias("dev_id")).where("dev_id IS NOT NULL").distinct()
    return trace.device_counts(events, sizes)


@query(
    "trace_info_str",
    f"""{sql.simulated('gpipe')} SELECT trace_id, dev_id, '[' || string_agg('<Event ' || event_num || ':' || name || '>', ', ' ORDER BY seq) || ']' AS info FROM tr GROUP BY 1, 2""",
)
def trace_info_str(spark, sf):
    return trace.info_strings(_sim(_sound(spark, sf, "gpipe"), "gpipe"))


@query("trace_event_types", f"SELECT event_id, event_type, coalesce(event_type IN {tuple(EVENT_TYPES)}, false) AS known FROM (SELECT DISTINCT event_id, event_type FROM trace_events)")
def trace_event_types(spark, sf):
    """The domain check of event types."""
    x = load(spark, sf, "trace_events").select("event_id", "event_type").distinct()
    return x.withColumn("known", event_type_is_known(F.col("event_type")))


@query("trace_set_times", f"WITH {_CLEAN} SELECT * REPLACE (CAST(event_num * 10 AS BIGINT) AS ts, CAST(dur * 2 AS BIGINT) AS dur) FROM n")
def trace_set_times(spark, sf):
    return trace.set_times(_tables(spark, sf)[0], F.col("event_num") * 10, F.col("dur") * 2)


@query(
    "trace_append",
    f"""{sql.simulated('gpipe')}, m AS (SELECT trace_id, dev_id, max(seq) AS l FROM tr GROUP BY 1, 2)
    SELECT * FROM tr UNION ALL SELECT tr.* REPLACE (l + 1 + tr.seq AS seq) FROM tr JOIN m USING (trace_id, dev_id)""",
)
def trace_append(spark, sf):
    t = cut(_sim(_sound(spark, sf, "gpipe"), "gpipe"))  # read three times
    return trace.add_events(t, t)


@query(
    "trace_meta_derived",
    f"""{sql.simulated('zbv')} SELECT trace_id, max(dev_id) + 1 AS ndevs, max(stage_id) + 1 AS nstages, max(microbatch_id) + 1 AS nmicrobatches, max(chunk_id) + 1 AS nchunks FROM tr GROUP BY 1""",
)
def trace_meta_derived(spark, sf):
    return trace.trace_meta(_sim(_sound(spark, sf, "zbv"), "zbv"))


@query(
    "event_equality",
    f"""WITH {_CLEAN}, a AS (SELECT * FROM n), b AS (SELECT DISTINCT * FROM nodes)
    SELECT a.event_num AS a_num, b.event_num AS b_num FROM a JOIN b ON a.event_num IS NOT DISTINCT FROM b.event_num AND a.event_type IS NOT DISTINCT FROM b.event_type
    AND a.name IS NOT DISTINCT FROM b.name AND a.ts IS NOT DISTINCT FROM b.ts AND a.dur IS NOT DISTINCT FROM b.dur""",
)
def event_equality(spark, sf):
    return trace.equal_events(_tables(spark, sf)[0], load(spark, sf, "nodes").distinct())


# ---------------------------------------------------------------- layout

_SUMMARY = """
ls0 AS (SELECT trace_id, count(DISTINCT dev_id) AS n_rows, CAST(min(ts) AS DOUBLE) AS first_time, greatest(0.0, CAST(max(ts + dur) AS DOUBLE)) AS last_time,
  greatest(1, max(coalesce(chunk_id, 0))) AS max_chunk, least(2000.0::DOUBLE, min(dur / (length(name) * 20 * 0.3::DOUBLE))) AS time_per_unit FROM tr GROUP BY 1),
ls AS (SELECT *, CAST(floor((last_time - first_time + time_per_unit - 1) / time_per_unit) AS BIGINT) + 50 AS data_width, CAST(20 * n_rows + n_rows + 1 AS BIGINT) AS data_height FROM ls0)"""


_DRAWN = "fwd_time > 0 AND bwd_time > 0 AND wgt_time > 0"


@query(
    "layout_summary",
    f"{sql.simulated('zbv', _DRAWN)},{_SUMMARY} SELECT *, data_width + 120 AS canvas_width, data_height + 175 AS canvas_height FROM ls",
)
def layout_summary(spark, sf):
    return layout.summary(_sim(_drawable(spark, sf, "zbv"), "zbv"))


def _drawable(spark: SparkSession, sf_dir: str, schedule: str) -> DataFrame:
    """Configurations without a free step; a bar of no width has no scale."""
    return _sound(spark, sf_dir, schedule).where(_DRAWN)


_BASE = "(VALUES ('FWD', 57, 122, 242), ('BWD', 62, 181, 191), ('WGT', 41, 137, 64), ('COMM', 255, 217, 102), ('OPRT', 255, 217, 102)) AS col(ty, r, g, b)"


def _mixed(c: str, chunk: str) -> str:
    return f"lpad(lower(to_hex(CAST(floor({c} + (255 - {c}) * ({chunk} * 70.0::DOUBLE / max_chunk / 100)) AS BIGINT))), 2, '0')"


@query(
    "layout_bars",
    f"""{sql.simulated('zbv', _DRAWN)},{_SUMMARY},
    rows_ AS (SELECT trace_id, dev_id, row_number() OVER (PARTITION BY trace_id ORDER BY dev_id) - 1 AS r_ FROM (SELECT DISTINCT trace_id, dev_id FROM tr)),
    br AS (SELECT tr.*, r_, max_chunk, 1 + CAST(floor((ts - first_time) / time_per_unit) AS BIGINT) AS x, CAST(floor(dur / time_per_unit) AS BIGINT) AS width FROM tr JOIN ls USING (trace_id) JOIN rows_ USING (trace_id, dev_id))
    SELECT trace_id, dev_id, seq, event_num, name, x, width, CAST(r_ * 20 + r_ + 1 AS INT) AS y, x + width // 2 AS center,
    '#' || {_mixed('r', 'chunk_id')} || {_mixed('g', 'chunk_id')} || {_mixed('b', 'chunk_id')} AS color FROM br JOIN {_BASE} ON ty = event_type""",
)
def layout_bars(spark, sf):
    return layout.bars(cut(_sim(_drawable(spark, sf, "zbv"), "zbv")))  # read three times


@query(
    "layout_colors",
    f"""SELECT ty AS event_type, CAST(c AS INT) AS chunk_id, '#' || {_mixed('r', 'c')} || {_mixed('g', 'c')} || {_mixed('b', 'c')} AS color
    FROM {_BASE}, range(0, 8) t(c), (SELECT 7 AS max_chunk)""",
)
def layout_colors(spark, sf):
    x = spark.range(8).select(F.col("id").cast("int").alias("chunk_id")).withColumn("event_type", F.explode(F.array(*map(F.lit, EVENT_TYPES))))
    return x.select("event_type", "chunk_id", layout.color(F.col("event_type"), F.col("chunk_id"), F.lit(7)).alias("color"))


@query(
    "layout_legend",
    f"""{sql.simulated('zbv', _DRAWN)},{_SUMMARY},
    fs AS (SELECT trace_id, event_type, min(dev_id * 1000000 + seq) AS first_at FROM tr GROUP BY 1, 2),
    po AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY first_at) - 1 AS position, count(*) OVER (PARTITION BY trace_id) AS nt FROM fs)
    SELECT trace_id, event_type, CAST(position AS INT) AS position, lower(substr(event_type, 1, 3)) AS label, CAST(((data_width + 120) // (nt + 2)) * (position + 1) AS BIGINT) AS x,
    '#' || lpad(lower(to_hex(r)), 2, '0') || lpad(lower(to_hex(g)), 2, '0') || lpad(lower(to_hex(b)), 2, '0') AS color FROM po JOIN ls USING (trace_id) JOIN {_BASE} ON ty = event_type""",
)
def layout_legend(spark, sf):
    return layout.legend(cut(_sim(_drawable(spark, sf, "zbv"), "zbv")))  # read twice


@query(
    "layout_device_rows",
    """SELECT trace_id, dev_id, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY dev_id) - 1 AS INT) AS "row", 'Device ' || dev_id AS title FROM (
    SELECT DISTINCT graph_id AS trace_id, stage_id AS dev_id FROM nodes)""",
)
def layout_device_rows(spark, sf):
    n = load(spark, sf, "nodes").select(F.col("graph_id").alias("trace_id"), F.col("stage_id").alias("dev_id"))
    return layout.device_rows(n)


@query(
    "layout_svg_elements",
    f"""{sql.simulated('zbv', _DRAWN)},{_SUMMARY},
    dv AS (SELECT trace_id, dev_id, row_number() OVER (PARTITION BY trace_id ORDER BY dev_id) - 1 AS r_ FROM (SELECT DISTINCT trace_id, dev_id FROM tr)),
    br AS (SELECT tr.*, r_, max_chunk, 1 + CAST(floor((ts - first_time) / time_per_unit) AS BIGINT) AS x, CAST(floor(dur / time_per_unit) AS BIGINT) AS width,
      row_number() OVER (PARTITION BY trace_id ORDER BY dev_id, seq) AS place FROM tr JOIN ls USING (trace_id) JOIN dv USING (trace_id, dev_id)),
    bc AS (SELECT br.*, '#' || {_mixed('r', 'chunk_id')} || {_mixed('g', 'chunk_id')} || {_mixed('b', 'chunk_id')} AS color FROM br JOIN {_BASE} ON ty = event_type),
    fs AS (SELECT trace_id, event_type, min(dev_id * 1000000 + seq) AS first_at FROM tr GROUP BY 1, 2),
    lg AS (SELECT trace_id, event_type, row_number() OVER (PARTITION BY trace_id ORDER BY first_at) - 1 AS p, count(*) OVER (PARTITION BY trace_id) AS nt FROM fs),
    lx AS (SELECT lg.*, data_height AS h, CAST(((data_width + 120) // (nt + 2)) * (p + 1) AS BIGINT) AS x,
      '#' || lpad(lower(to_hex(r)), 2, '0') || lpad(lower(to_hex(g)), 2, '0') || lpad(lower(to_hex(b)), 2, '0') AS color FROM lg JOIN ls USING (trace_id) JOIN {_BASE} ON ty = event_type),
    el(trace_id, layer, "at", tag, x, y, width, height, fill, text) AS (
      SELECT trace_id, 0, r_, 'text', 12, r_ * 20 + r_ + 1, 0, 0, NULL, 'Device ' || dev_id FROM dv
      UNION ALL SELECT trace_id, 1, r_, 'line', 120, r_ * 20 + r_ + 1 + 20, data_width - 1, 0, NULL, NULL FROM dv JOIN ls USING (trace_id)
      UNION ALL SELECT trace_id, 2, place, 'rect', x + 120, r_ * 20 + r_ + 1, width, 20, color, NULL FROM bc
      UNION ALL SELECT trace_id, 3, place, 'text', x + width // 2 + 120, r_ * 20 + r_ + 1 + 4, 0, 0, NULL, name FROM bc
      UNION ALL SELECT trace_id, 4, 0, 'text', 12, data_height, 0, 0, NULL, 'Time' FROM ls
      UNION ALL SELECT trace_id, 5, p, 'rect', x, h + 33, 50, 20, color, NULL FROM lx
      UNION ALL SELECT trace_id, 6, p, 'text', x + 56, h + 33, 0, 0, NULL, lower(substr(event_type, 1, 3)) FROM lx)
    SELECT trace_id, CAST(layer AS INT) AS layer, CAST("at" AS BIGINT) AS "at", tag, x::DOUBLE AS x, y::DOUBLE AS y, width::DOUBLE AS width, height::DOUBLE AS height, fill, text FROM el""",
)
def layout_svg_elements(spark, sf):
    """Everything the drawing sink draws."""
    return svg.elements(cut(_sim(_drawable(spark, sf, "zbv"), "zbv")))


# ---------------------------------------------------------------- all sound configurations


def _critical_path(c: DataFrame) -> DataFrame:
    nodes, edges = graph_nodes(c), graph_edges(c)
    return metrics.critical_path(simulate(nodes, edges), graph.numbered_edges(nodes, edges))


def _over_all(name: str, run: Callable[[DataFrame], DataFrame], schedule: str, where: str = "TRUE") -> None:
    """The query ``name``, which covers ``schedule``, over the sound configurations of all schedules."""
    tail = ORACLE[name].removeprefix(sql.simulated(schedule, where))

    @query(f"{name}_all", " UNION ALL ".join(f"SELECT * FROM ({sql.simulated(each, where)}{tail})" for each in SCHEDULES))
    def _run(spark, sf):
        return run(_sound(spark, sf, None).where(where))


def _traced(c: DataFrame) -> DataFrame:
    return simulate(graph_nodes(c), graph_edges(c))


def _appended(c: DataFrame) -> DataFrame:
    t = cut(_traced(c))  # read three times
    return trace.add_events(t, t)


for _n, _s, _f in (
    ("sim_configs", "zbv", simulate_configs),
    ("metrics_makespan", "zb", lambda c: metrics.makespan(_traced(c))),
    ("metrics_stage_busy", "zbv", lambda c: metrics.stage_busy(_traced(c))),
    ("metrics_bubble", "interleaved", lambda c: metrics.bubble(_traced(c), c.select(F.col("graph_id").alias("trace_id"), "nstages"))),
    ("metrics_idle_gaps", "pipedream", lambda c: metrics.idle_gaps(_traced(c))),
    ("metrics_phase_times", "zb", lambda c: metrics.phase_times(_traced(c))),
    ("metrics_critical_path", "gpipe", _critical_path),
    ("trace_info_str", "gpipe", lambda c: trace.info_strings(_traced(c))),
    ("trace_append", "gpipe", _appended),
    ("trace_meta_derived", "zbv", lambda c: trace.trace_meta(_traced(c))),
):
    _over_all(_n, _f, _s)
for _n, _f in (("layout_summary", layout.summary), ("layout_bars", layout.bars), ("layout_legend", layout.legend), ("layout_svg_elements", svg.elements)):
    _over_all(_n, lambda c, f=_f: f(cut(_traced(c))), "zbv", _DRAWN)  # a bar of no width has no scale


# ---------------------------------------------------------------- profiler documents

_KINDS = "CASE user_id % 3 WHEN 0 THEN 'forward_step-' WHEN 1 THEN 'backward_step-' ELSE 'wait-' END || event_id"


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as raw profiler events, one document per user."""
    kind = F.when(F.col("user_id") % 3 == 0, "forward_step-").when(F.col("user_id") % 3 == 1, "backward_step-").otherwise("wait-")
    return load(spark, sf_dir, "events").select(
        F.col("user_id").alias("trace_id"), "event_id", F.concat(kind, F.col("event_id").cast("string")).alias("name"),
        (F.col("event_id") % 8).cast("string").alias("tid"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("ts"), F.floor(F.col("value") * 1000).cast("double").alias("dur"),
    )


_RAW = f"""raw AS (SELECT user_id AS trace_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS event_num, {_KINDS} AS name,
  event_id % 8 AS dev_id, CAST(epoch_us(ts) AS DOUBLE) AS ts, CAST(floor(value * 1000) AS DOUBLE) AS dur FROM events)"""


@query(
    "trace_json_roundtrip",
    f"""WITH {_RAW} SELECT trace_id, 8 AS ndevs, CAST(dev_id AS INT) AS dev_id, CAST(event_num AS BIGINT) AS event_num, CASE WHEN starts_with(name, 'f') THEN 'FWD' ELSE 'BWD' END AS event_type,
    name, ts, dur, CAST(event_num - 1 AS BIGINT) AS seq FROM raw WHERE starts_with(name, 'forward_step') OR starts_with(name, 'backward_step')""",
)
def trace_json_roundtrip(spark, sf):
    """Documents written as JSON, read with the reader's schema, and taken apart again."""
    docs = _documents(_profile(spark, sf), "trace_id")
    text = docs.select("trace_id", F.to_json(F.struct("distributedInfo", "traceEvents")).alias("doc"))
    parsed = text.select("trace_id", F.from_json("doc", DOC_SCHEMA).alias("d")).select("trace_id", "d.*")
    return events_of(parsed, ["FWD", "BWD", "WGT"], ["trace_id"])


@query(
    "trace_prefix_classify",
    """SELECT event_id, name, CASE WHEN starts_with(name, 'backward_step') THEN 'BWD' WHEN starts_with(name, 'forward_step') THEN 'FWD' END AS event_type
    FROM (SELECT DISTINCT event_id, name FROM trace_events) WHERE starts_with(name, 'forward_step') OR starts_with(name, 'backward_step')""",
)
def trace_prefix_classify(spark, sf):
    x = load(spark, sf, "trace_events").select("event_id", "name").distinct()
    return x.withColumn("event_type", classify(F.col("name"), ["BWD", "FWD", "COMM"])).where(F.col("event_type").isNotNull())


@query(
    "trace_ordinal_ids",
    """WITH d AS (SELECT DISTINCT record_id, payload FROM trace_json WHERE json_valid(payload)),
    x AS (SELECT record_id, i, json_extract_string(payload, '$.traceEvents[' || i || '].name') AS name
      FROM (SELECT *, unnest(range(CAST(json_array_length(payload, '$.traceEvents') AS BIGINT))) AS i FROM d))
    SELECT record_id, CAST(i + 1 AS BIGINT) AS event_num, name, CASE WHEN starts_with(name, 'forward_step') THEN 'FWD' ELSE 'BWD' END AS event_type
    FROM x WHERE starts_with(name, 'forward_step') OR starts_with(name, 'backward_step')""",
)
def trace_ordinal_ids(spark, sf):
    """Ids count all raw events of a document; those of other kinds are dropped after counting."""
    docs = load(spark, sf, "trace_json").select("record_id", "payload").dropDuplicates(["record_id"])
    raw = docs.select("record_id", F.from_json("payload", "traceEvents array<struct<name: string>>").alias("d"))
    x = raw.select("record_id", F.posexplode("d.traceEvents").alias("pos", "e"))
    return x.select("record_id", (F.col("pos") + 1).cast("long").alias("event_num"), F.col("e.name").alias("name"), classify(F.col("e.name"), ["FWD", "BWD"]).alias("event_type")).where(
        F.col("event_type").isNotNull()
    )


def _documents(profile: DataFrame, by: str) -> DataFrame:
    """Raw profiler events as documents, one per value of ``by``, events in order of their id."""
    e = F.struct("event_id", "name", "tid", "ts", "dur")
    listed = F.transform(F.array_sort(F.collect_list(e)), lambda x: F.struct(x["name"].alias("name"), x["tid"].alias("tid"), x["ts"].alias("ts"), x["dur"].alias("dur")))
    return profile.groupBy(by).agg(F.struct(F.lit(8).alias("world_size")).alias("distributedInfo"), listed.alias("traceEvents"))


@query(
    "trace_scan",
    f"""WITH {_RAW} SELECT trace_id, CAST(dev_id AS INT) AS dev_id, CAST(count(*) AS BIGINT) AS n_events, min(ts) AS first_ts, max(ts + dur) AS last_end FROM raw
    WHERE starts_with(name, 'forward_step') OR starts_with(name, 'backward_step') GROUP BY 1, 2""",
)
def trace_scan(spark, sf):
    """A scan of profiler files: documents written to the shared folder, one per line, and read by the reader."""
    path = new_path(spark, ".json")
    _documents(_profile(spark, sf).withColumn("trace_id", F.col("trace_id").cast("string")), "trace_id").write.json(path)
    reader = ProfilerJson(path, lines=True)
    reader.read(spark, ["FWD", "BWD"])
    x = reader.outputs[-1]
    found = x.groupBy("trace_id", "dev_id").agg(F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("first_ts"), F.max(F.col("ts") + F.col("dur")).alias("last_end"))
    return found.withColumn("trace_id", F.col("trace_id").cast("long"))


@query(
    "reader_json",
    f"""WITH r AS (SELECT user_id % 16 AS file, row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) AS event_num, {_KINDS} AS name, event_id % 8 AS dev_id,
      CAST(epoch_us(ts) AS DOUBLE) AS ts, CAST(floor(value * 1000) AS DOUBLE) AS dur FROM events)
    SELECT CAST(file AS BIGINT) AS file, 8 AS ndevs, CAST(dev_id AS INT) AS dev_id, CAST(event_num AS BIGINT) AS event_num,
      CASE WHEN starts_with(name, 'f') THEN 'FWD' ELSE 'BWD' END AS event_type, name, ts, dur, CAST(event_num - 1 AS BIGINT) AS seq FROM r
    WHERE starts_with(name, 'forward_step') OR starts_with(name, 'backward_step')""",
)
def reader_json(spark, sf):
    """One document per file, pretty printed, the file being the trace."""
    path = new_path(spark)
    docs = _documents(_profile(spark, sf).withColumn("file", F.col("trace_id") % 16), "file")
    docs.select("file", F.to_json(F.struct("distributedInfo", "traceEvents"), {"pretty": "true"}).alias("value")).write.partitionBy("file").text(path)
    found = ProfilerJson(f"{path}/*/*.txt").read(spark, ["FWD", "BWD"])
    return found.select(F.regexp_extract("trace_id", "/file=([0-9]+)/", 1).cast("long").alias("file"), *found.columns[1:])


_ROWS = f"""WITH r AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS seq, {_KINDS} AS name, event_id % 8 AS dev_id, CAST(epoch_us(ts) AS DOUBLE) AS ts, CAST(floor(value * 1000) AS DOUBLE) AS dur FROM events)
    SELECT CAST(dev_id AS INT) AS dev_id, CAST(seq AS BIGINT) AS seq, CASE WHEN starts_with(name, 'f') THEN 'FWD' ELSE 'BWD' END AS event_type, name, ts, dur FROM r
    WHERE starts_with(name, 'forward_step') OR starts_with(name, 'backward_step')"""


@query("reader_csv", _ROWS)
def reader_csv(spark, sf):
    """A CSV export in one file, the place of a row told by the splits it is read in."""
    path = new_path(spark, ".csv")
    _profile(spark, sf).repartition(1).sortWithinPartitions("event_id").select("name", "tid", "ts", "dur").write.option("header", True).csv(path)
    return ProfilerTable(path).read(spark, ["FWD", "BWD"]).drop("trace_id")


@query("reader_parquet", _ROWS)
def reader_parquet(spark, sf):
    path = new_path(spark, ".parquet")
    _profile(spark, sf).repartition(1).sortWithinPartitions("event_id").select("name", "tid", "ts", "dur").write.parquet(path)
    return ProfilerTable(path).read(spark, ["FWD", "BWD"]).drop("trace_id")


# ---------------------------------------------------------------- workflow and stream


@query("flow_pipeline_demo", f"{_hetero_sql('gpipe')},{sql.SIMULATE} SELECT trace_id, CAST(max(ts + dur) AS BIGINT) AS makespan FROM tr GROUP BY 1")
def flow_pipeline_demo(spark, sf):
    """Build, filter, merge, simulate and measure as a workflow; one lazy plan in the end."""
    flow = FlowGraph()
    flow.add_node(FlowNode("configurations", 0, lambda _: _sound(spark, sf, "gpipe")))
    flow.add_node(FlowNode("filter and merge", 1, lambda i: _hetero(i[0], "gpipe")))
    flow.add_node(steps.simulate_step(2))
    flow.add_node(FlowNode("makespan", 3, lambda i: metrics.makespan(i[0])))
    for a in range(3):
        flow.add_edge(a, a + 1)
    return flow.run()[3][0]


_PAIR = "(VALUES ('mixed', 'gpipe', 4, 10, 1, 1000, 2000, 3000, false)) AS t(graph_id, schedule, nstages, nmicrobatches, nchunks, fwd_time, bwd_time, wgt_time, eager)"


@query("flow_steps", f"{_hetero_sql('gpipe', _PAIR)},{sql.SIMULATE} SELECT * FROM tr")
def flow_steps(spark, sf):
    """Two graphs, filtered, merged with edges written by hand, and simulated, all by the workflow's own steps."""
    build = lambda f, b: PipelineGraph.build(spark, "g", "gpipe", 4, 10, fwd_time=f, bwd_time=b, wgt_time=3000)
    by_hand = [(("FWD", 1, m, 0), ("FWD", 2, m, 0)) for m in range(10)] + [(("BWD", 2, m, 0), ("BWD", 1, m, 0)) for m in range(10)]
    flow = FlowGraph()
    flow.add_node(FlowNode("fast", 0, lambda _: build(1000, 2000)))
    flow.add_node(FlowNode("slow", 1, lambda _: build(2000, 1000)))
    for step in (steps.filter_step(2, [0, 1]), steps.filter_step(3, [2, 3]), steps.merge_step(4, "mixed", by_hand), steps.simulate_step(5)):
        flow.add_node(step)
    for a, b in ((0, 2), (1, 3), (2, 4), (3, 4), (4, 5)):
        flow.add_edge(a, b)
    return flow.run()[5][0]


class _Counted(FlowNode):
    """A step of one's own: how many rows each trace has."""

    def run(self):
        return [t.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")) for t in self.inputs]


@query(
    "flow_check",
    f"""WITH {sql.configs(f"schedule = 'gpipe' AND {sql.SOUND}")} SELECT graph_id AS trace_id, CAST(2 * nstages * nmicrobatches * nchunks AS BIGINT) AS n, true AS fits, false AS misfits FROM cfg""",
)
def flow_check(spark, sf):
    """A step of one's own behind checked inputs; a step that needs another column is told so before it runs."""
    needs = T.StructType([T.StructField("trace_id", T.StringType()), T.StructField("ts", T.LongType())])

    def flow(wanted: T.StructType) -> FlowGraph:
        out = FlowGraph()
        out.add_node(FlowNode("simulate", 0, lambda _: _sim(_sound(spark, sf, "gpipe"), "gpipe")))
        out.add_node(_Counted("count", 1, needs=wanted))
        out.add_edge(0, 1)
        return out

    def fits(wanted: T.StructType) -> bool:
        try:
            flow(wanted).run()
        except TypeError:
            return False
        return True

    found = flow(needs).run()[1][0]
    return found.withColumns({"fits": F.lit(fits(needs)), "misfits": F.lit(fits(needs.add("dev_id", T.StringType())))})


@query(
    "stream_device_load",
    """SELECT trace_id, tid, date_trunc('hour', captured_at) AS window_start, sum(dur) AS busy_us, CAST(count(*) AS BIGINT) AS n_events FROM (
    SELECT DISTINCT event_id, trace_id, tid, captured_at, dur FROM trace_events WHERE dur > 0 AND dur <= 10000000) GROUP BY 1, 2, 3""",
)
def stream_device_load(spark, sf):
    """The streaming aggregation, over the whole table as a batch."""
    events = load(spark, sf, "trace_events").where("dur > 0 AND dur <= 10000000")
    return device_load(events).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
