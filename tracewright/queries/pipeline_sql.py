"""SQL forms of the pipeline queries, written rule by rule and independently of the Spark plans."""

from __future__ import annotations

_T = ("FWD", "BWD", "WGT")


def configs(where: str = "TRUE", table: str = "config") -> str:
    return f"cfg AS (SELECT * FROM {table} WHERE {where})"


NODES = """
k AS (SELECT cfg.*, t, s, m, c FROM cfg, range(0, 3) AS a(t), range(0, 64) AS b(s), range(0, 512) AS d(m), range(0, 16) AS f(c)
  WHERE s < nstages AND m < nmicrobatches AND c < nchunks AND (t < 2 OR schedule IN ('zb', 'zbv'))),
n AS (SELECT graph_id, CAST(((t * nstages + s) * nmicrobatches + m) * nchunks + c + 1 AS BIGINT) AS event_num,
  CASE t WHEN 0 THEN 'FWD' WHEN 1 THEN 'BWD' ELSE 'WGT' END AS event_type, CAST(s AS INT) AS stage_id, CAST(m AS INT) AS microbatch_id, CAST(c AS INT) AS chunk_id,
  CASE t WHEN 0 THEN 'F' WHEN 1 THEN 'B' ELSE 'W' END || ':' || m || '-' || c AS name, CAST(-1 AS BIGINT) AS ts,
  CASE t WHEN 0 THEN fwd_time WHEN 1 THEN bwd_time ELSE wgt_time END AS dur FROM k)"""

_HEAD = "graph_id, src_type, src_stage, src_mb, src_chk, dst_type, dst_stage, dst_mb, dst_chk"


def _rule(src: int, dst: int, where: str, s: str = "s", m: str = "m", c: str = "c", extra: str = "") -> str:
    return (
        f"SELECT graph_id, '{_T[src]}', s, m, c, '{_T[dst]}', {s}, {m}, {c} FROM k{extra} WHERE t = {src} AND {where}"
    )


_END = "nstages - 1"
_RULES = {
    "gpipe": [
        _rule(0, 0, "m < nmicrobatches - 1", m="m + 1"),
        _rule(0, 1, "m = nmicrobatches - 1", m="0"),
        _rule(0, 0, f"s < {_END}", s="s + 1"),
        _rule(1, 1, "m < nmicrobatches - 1", m="m + 1"),
        _rule(1, 1, "s > 0", s="s - 1"),
    ],
    "zb": [
        *[_rule(t, t, "m < nmicrobatches - 1", m="m + 1") for t in (0, 1, 2)],
        _rule(0, 0, f"s < {_END}", s="s + 1"),
        _rule(0, 0, "s = 0 AND c > 0", s="s", c="c").replace("'FWD', s, m, c, 'FWD', s, m, c", f"'FWD', {_END}, m, c - 1, 'FWD', s, m, c"),
        _rule(1, 1, "s > 0", s="s - 1"),
        _rule(0, 1, f"s = {_END} AND c = nchunks - 1"),
        _rule(1, 1, "s = 0 AND c > 0", s=_END, c="c - 1"),
        _rule(1, 2, "TRUE"),
    ],
    "zbv": [
        *[_rule(t, t, "m < nmicrobatches - 1", m="m + 1") for t in (0, 1, 2)],
        _rule(0, 0, f"c & 1 = 0 AND s < {_END}", s="s + 1"),
        _rule(0, 0, "c & 1 = 1 AND s > 0", s="s - 1"),
        _rule(0, 0, f"c + 1 < nchunks AND (c & 1 = 0 AND s = {_END} OR c & 1 = 1 AND s = 0)", c="c + 1"),
        _rule(1, 1, "c & 1 = 0 AND s > 0", s="s - 1"),
        _rule(1, 1, f"c & 1 = 1 AND s < {_END}", s="s + 1"),
        _rule(1, 1, f"c > 0 AND (c & 1 = 1 AND s = {_END} OR c & 1 = 0 AND s = 0)", c="c - 1"),
        _rule(0, 1, "s = 0 AND c = nchunks - 1"),
        _rule(1, 2, "TRUE"),
    ],
}
_WARM = "least(CASE WHEN eager THEN 2 * (nstages - s) - 1 ELSE nstages - s END, nmicrobatches)"
_RULES["pipedream"] = [
    _rule(0, 0, f"m + 1 < {_WARM}", m="m + 1"),
    _rule(0, 1, f"m + 1 = {_WARM}", m="0"),
    _rule(0, 0, f"m < {_WARM} AND s < {_END}", s="s + 1"),
    _rule(1, 1, "s > 0", s="s - 1"),
    _rule(1, 0, f"m + {_WARM} < nmicrobatches", m=f"m + {_WARM}"),
    _rule(1, 1, f"m + {_WARM} >= nmicrobatches AND m < nmicrobatches - 1", m="m + 1"),
    _rule(0, 1, f"m >= {_WARM} AND m - {_WARM} < nmicrobatches - 1", m=f"m - {_WARM} + 1"),
]

# the interleaved schedule by joins on the position in the order of execution
_INTERLEAVED = """
p AS (SELECT *, nstages * (nchunks - 1) + 2 * (nstages - s) - 2 AS w, nmicrobatches * nchunks AS total,
    CASE WHEN t = 0 THEN c ELSE nchunks - 1 - c END AS x FROM k),
q AS (SELECT *, CASE WHEN m >= (nmicrobatches // nstages) * nstages
    THEN (nmicrobatches // nstages) * nstages * nchunks + (nmicrobatches % nstages) * x + m % nstages
    ELSE (m // nstages) * nstages * nchunks + nstages * x + m % nstages END AS i FROM p),
f AS (SELECT * FROM q WHERE t = 0), b AS (SELECT * FROM q WHERE t = 1),
e0(graph_id, src_type, src_stage, src_mb, src_chk, dst_type, dst_stage, dst_mb, dst_chk) AS (
  SELECT a.graph_id, 'FWD', a.s, a.m, a.c, 'FWD', z.s, z.m, z.c FROM f a JOIN f z ON z.graph_id = a.graph_id AND z.s = a.s AND z.i = a.i + 1 WHERE a.i < a.w
  UNION ALL SELECT a.graph_id, 'FWD', a.s, a.m, a.c, 'FWD', z.s, z.m, z.c FROM f a JOIN f z ON z.graph_id = a.graph_id AND z.s = a.s + 1 AND z.i = a.i WHERE a.i < a.w
  UNION ALL SELECT a.graph_id, 'FWD', a.s, a.m, a.c, 'BWD', z.s, z.m, z.c FROM f a JOIN b z ON z.graph_id = a.graph_id AND z.s = a.s AND a.i = z.i + z.w
  UNION ALL SELECT a.graph_id, 'BWD', a.s, a.m, a.c, 'FWD', z.s, z.m, z.c FROM b a JOIN f z ON z.graph_id = a.graph_id AND z.s = a.s AND z.i = a.i + a.w + 1
  UNION ALL SELECT a.graph_id, 'BWD', a.s, a.m, a.c, 'BWD', z.s, z.m, z.c FROM b a JOIN b z ON z.graph_id = a.graph_id AND z.s = a.s AND z.i = a.i + 1 WHERE a.i >= a.total - a.w - 1
  UNION ALL SELECT a.graph_id, 'BWD', a.s, a.m, a.c, 'BWD', z.s, z.m, z.c FROM b a JOIN b z ON z.graph_id = a.graph_id AND z.s = a.s - 1 AND z.i = a.i)
"""


def edges(schedule: str) -> str:
    """CTEs ending in ``ed``, the distinct edges of ``cfg`` (one schedule)."""
    body = _INTERLEAVED if schedule == "interleaved" else f"e0({_HEAD}) AS (" + "\n UNION ALL ".join(_RULES[schedule]) + ")"
    cast = ", ".join(f"CAST({c} AS {'VARCHAR' if c.endswith('type') or c == 'graph_id' else 'INT'}) AS {c}" for c in _HEAD.split(", "))
    return f"{body},\ned AS (SELECT DISTINCT {cast} FROM e0)"


SOUND = (
    "nstages > 0 AND nmicrobatches > 0 AND nchunks > 0 AND (nchunks = 1 OR schedule NOT IN ('gpipe', 'pipedream')) "
    "AND (schedule <> 'interleaved' OR nstages * (nchunks - 1) + 2 * nstages - 2 < nmicrobatches * nchunks) AND (schedule <> 'zbv' OR nchunks % 2 = 0)"
)

#: From n (nodes) and ed (edges): the simulated trace, by hop depth, rank in the wave and longest path.
SIMULATE = """
nn AS (SELECT *, dense_rank() OVER (ORDER BY graph_id) * 1000000 + event_num AS k, coalesce(dur, 0) AS d FROM n),
ee AS (SELECT x.k AS a, y.k AS b FROM ed
  JOIN nn x ON x.graph_id = ed.graph_id AND x.event_type = src_type AND x.stage_id = src_stage AND x.microbatch_id = src_mb AND x.chunk_id = src_chk
  JOIN nn y ON y.graph_id = ed.graph_id AND y.event_type = dst_type AND y.stage_id = dst_stage AND y.microbatch_id = dst_mb AND y.chunk_id = dst_chk),
depth0(k, h) AS (SELECT k, 0 FROM nn WHERE k NOT IN (SELECT b FROM ee) UNION SELECT ee.b, r.h + 1 FROM depth0 r JOIN ee ON ee.a = r.k),
depth AS (SELECT k, max(h) AS h FROM depth0 GROUP BY k),
tight AS (SELECT ee.a, ee.b FROM ee JOIN depth da ON da.k = ee.a JOIN depth db ON db.k = ee.b WHERE db.h = da.h + 1),
wave(h, k, rk) AS (
  SELECT 0, k, row_number() OVER (PARTITION BY graph_id ORDER BY event_num) FROM nn WHERE k NOT IN (SELECT b FROM ee)
  UNION ALL
  SELECT h + 1, b, row_number() OVER (PARTITION BY g ORDER BY lr, num) FROM (
    SELECT w.h, t.b, max(w.rk) AS lr, any_value(nn.event_num) AS num, any_value(nn.graph_id) AS g
    FROM wave w JOIN tight t ON t.a = w.k JOIN nn ON nn.k = t.b GROUP BY w.h, t.b)),
pop AS (SELECT wave.k, row_number() OVER (PARTITION BY graph_id ORDER BY h, rk) AS p FROM wave JOIN nn USING (k)),
chain AS (SELECT lag(pop.k) OVER (PARTITION BY graph_id, stage_id ORDER BY p) AS a, pop.k AS b FROM pop JOIN nn USING (k)),
e2 AS (SELECT a, b FROM ee UNION SELECT a, b FROM chain WHERE a IS NOT NULL AND b IN (SELECT b FROM ee)),
fin(k, t) USING KEY (k) AS (SELECT k, d FROM nn WHERE k NOT IN (SELECT b FROM e2)
  UNION SELECT q.b, max(r.t + nn.d) FROM fin r JOIN e2 q ON q.a = r.k JOIN nn ON nn.k = q.b
    LEFT JOIN recurring.fin o ON o.k = q.b WHERE o.t IS NULL OR r.t + nn.d > o.t GROUP BY q.b),
tr AS (SELECT graph_id AS trace_id, stage_id AS dev_id, CAST(row_number() OVER (PARTITION BY graph_id, stage_id ORDER BY p) - 1 AS BIGINT) AS seq,
  event_num, event_type, name, CAST(fin.t - d AS BIGINT) AS ts, CAST(d AS BIGINT) AS dur, stage_id, microbatch_id, chunk_id
  FROM fin JOIN pop USING (k) JOIN nn USING (k))
"""


def simulated(schedule: str, where: str = "TRUE") -> str:
    """CTEs ending in ``tr`` for the sound configurations of one schedule."""
    return f"WITH RECURSIVE {configs(f'schedule = {schedule!r} AND {SOUND} AND {where}')},{NODES},\n{edges(schedule)},{SIMULATE}"


def cut_edges_sql(cut: int) -> str:
    """Rows of template edges over the cut, from ``cfg``."""
    return f"""
mc AS (SELECT cfg.*, m, c, (schedule = 'zbv' AND c % 2 = 1) AS odd FROM cfg, range(0, 512) AS d(m), range(0, 16) AS f(c) WHERE m < nmicrobatches AND c < nchunks AND nstages > {cut}),
cutted AS (
  SELECT graph_id, 'FWD' AS src_type, CASE WHEN odd THEN {cut} ELSE {cut - 1} END AS src_stage, m AS src_mb, c AS src_chk, 'FWD' AS dst_type, CASE WHEN odd THEN {cut - 1} ELSE {cut} END AS dst_stage, m AS dst_mb, c AS dst_chk FROM mc
  UNION ALL SELECT graph_id, 'BWD', CASE WHEN odd THEN {cut - 1} ELSE {cut} END, m, c, 'BWD', CASE WHEN odd THEN {cut} ELSE {cut - 1} END, m, c FROM mc
  UNION ALL SELECT graph_id, 'FWD', nstages - 1, m, c - 1, 'FWD', 0, m, c FROM mc WHERE schedule = 'zb' AND c > 0
  UNION ALL SELECT graph_id, 'BWD', 0, m, c, 'BWD', nstages - 1, m, c - 1 FROM mc WHERE schedule = 'zb' AND c > 0)"""
