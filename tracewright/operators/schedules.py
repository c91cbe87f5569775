"""Task graphs of pipeline schedules, as node and edge tables.

Configurations are rows, so a sweep over thousands of scenarios is one map-only
job: nodes come from exploded ranges, and the outgoing edges of a node are a
closed form of its own key and its configuration.  No join and no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.model import CONFIG_SCHEMA, EDGE_COLS, NO_TIMESTAMP, NODE_COLS, SCHEDULES, SPLIT_BACKWARD, event_name_col

_I = "int"


def config_frame(spark: SparkSession, rows: Sequence[dict]) -> DataFrame:
    """Checked configurations: known schedule, one chunk where the schedule needs it, even chunks for the V shape."""
    full = []
    for r in rows:
        r = {"nchunks": 1, "eager": False, "wgt_time": 1} | r
        if r["schedule"] not in SCHEDULES:
            raise ValueError(f"unknown schedule {r['schedule']!r}")
        if r["schedule"] in ("gpipe", "pipedream") and r["nchunks"] != 1:
            raise AssertionError(f"{r['schedule']} has one chunk")
        if r["schedule"] == "zbv" and r["nchunks"] % 2:
            raise ValueError("the V shape needs an even number of chunks")
        if any(r.get(c) is None for c in ("fwd_time", "bwd_time")):
            raise ValueError("a cost is missing")
        full.append(tuple(r[f.name] for f in CONFIG_SCHEMA.fields))
    return spark.createDataFrame(full, CONFIG_SCHEMA)


def config_is_sound(c: str = "") -> Column:
    """Configurations whose graph has no dangling edge."""
    col = lambda n: F.col(f"{c}.{n}" if c else n)
    s, m, k, sched = col("nstages"), col("nmicrobatches"), col("nchunks"), col("schedule")
    one = (k == 1) | ~sched.isin("gpipe", "pipedream")
    warm = (sched != "interleaved") | (s * (k - 1) + 2 * s - 2 < m * k)
    even = (sched != "zbv") | (k % 2 == 0)
    return sched.isin(*SCHEDULES) & (s > 0) & (m > 0) & (k > 0) & one & warm & even


def _keys(configs: DataFrame) -> DataFrame:
    """One row per node: configuration columns with t (0, 1, 2), s, m, c."""
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    kinds = F.when(F.col("schedule").isin(*SPLIT_BACKWARD), F.array(*map(F.lit, (0, 1, 2)))).otherwise(F.array(F.lit(0), F.lit(1)))
    out = configs.where((F.col("nstages") > 0) & (F.col("nmicrobatches") > 0) & (F.col("nchunks") > 0))
    out = out.withColumn("t", F.explode(kinds)).withColumn("s", F.explode(upto("nstages")))
    return out.withColumn("m", F.explode(upto("nmicrobatches"))).withColumn("c", F.explode(upto("nchunks")))


def _type(t: Column) -> Column:
    return F.when(t == 0, "FWD").when(t == 1, "BWD").otherwise("WGT")


def graph_nodes(configs: DataFrame) -> DataFrame:
    """Nodes of every configuration, numbered by type, stage, microbatch and chunk; not simulated yet."""
    x = _keys(configs)
    size = [F.col(c).cast("long") for c in ("nstages", "nmicrobatches", "nchunks")]
    num = ((F.col("t") * size[0] + F.col("s")) * size[1] + F.col("m")) * size[2] + F.col("c") + 1
    dur = F.when(F.col("t") == 0, F.col("fwd_time")).when(F.col("t") == 1, F.col("bwd_time")).otherwise(F.col("wgt_time"))
    kind = _type(F.col("t"))
    return x.select(
        "graph_id", num.alias("event_num"), kind.alias("event_type"),
        F.col("s").alias("stage_id"), F.col("m").alias("microbatch_id"), F.col("c").alias("chunk_id"),
        event_name_col(kind, F.col("m"), F.col("c")).alias("name"), F.lit(NO_TIMESTAMP).cast("long").alias("ts"), dur.cast("long").alias("dur"),
    ).select(*NODE_COLS)


def _to(t: int | Column, s: Column, m: Column, c: Column) -> Column:
    t = F.lit(t) if isinstance(t, int) else t
    return F.struct(t.cast(_I).alias("t"), s.cast(_I).alias("s"), m.cast(_I).alias("m"), c.cast(_I).alias("c"))


def _gpipe(t, s, m, c, S, M, C) -> list[Column]:
    fwd, bwd = t == 0, t == 1
    return [
        F.when(fwd & (m < M - 1), _to(0, s, m + 1, c)),
        F.when(fwd & (m == M - 1), _to(1, s, F.lit(0), c)),
        F.when(fwd & (s < S - 1), _to(0, s + 1, m, c)),
        F.when(bwd & (m < M - 1), _to(1, s, m + 1, c)),
        F.when(bwd & (s > 0), _to(1, s - 1, m, c)),
    ]


def _pipedream(t, s, m, c, S, M, C) -> list[Column]:
    fwd, bwd = t == 0, t == 1
    # forwards before the first backward
    warm = F.least(F.when(F.col("eager"), 2 * (S - s) - 1).otherwise(S - s), M)
    steady = fwd & (m >= warm)
    return [
        F.when(fwd & (m < warm - 1), _to(0, s, m + 1, c)),
        F.when(fwd & (m == warm - 1), _to(1, s, F.lit(0), c)),
        F.when(fwd & (m < warm) & (s < S - 1), _to(0, s + 1, m, c)),
        F.when(steady & (m - warm < M - 1), _to(1, s, m - warm + 1, c)),
        F.when(bwd & (s > 0), _to(1, s - 1, m, c)),
        F.when(bwd & (warm + m < M), _to(0, s, warm + m, c)),
        F.when(bwd & (warm + m >= M) & (m < M - 1), _to(1, s, m + 1, c)),
    ]


def _interleaved(t, s, m, c, S, M, C) -> list[Column]:
    """Targets by position: positions number the microbatch-chunk pairs in order of execution, see :func:`_by_position`."""
    fwd, bwd = t == 0, t == 1
    i, total, warm = F.col("place"), M * C, F.col("warm")
    at = lambda t, s, i: _to(t, s, i, F.lit(-1))
    return [
        F.when(fwd & (i < warm), at(0, s, i + 1)),
        F.when(fwd & (i < warm) & (s < S - 1), at(0, s + 1, i)),
        F.when(fwd & (i >= warm), at(1, s, i - warm)),
        F.when(bwd & (i < total - warm - 1), at(0, s, i + warm + 1)),
        F.when(bwd & (i >= total - warm - 1) & (i < total - 1), at(1, s, i + 1)),
        F.when(bwd & (s > 0), at(1, s - 1, i)),
    ]


def _div(a: Column, b: Column) -> Column:
    return F.floor(a / b).cast(_I)


def _with_place(x: DataFrame) -> DataFrame:
    """Add a node's position and its stage's forwards before the first backward.

    Blocks of S microbatches run chunk by chunk; what is left over forms a shorter block.  Backwards take chunks in reverse.
    """
    S, M, C, m = (F.col(n) for n in ("nstages", "nmicrobatches", "nchunks", "m"))
    k = F.when(F.col("t") == 0, F.col("c")).otherwise(C - 1 - F.col("c"))
    whole = _div(M, S) * S
    place = F.when(m >= whole, whole * C + (M % S) * k + m % S).otherwise(_div(m, S) * S * C + S * k + m % S)
    return x.withColumns({"place": place.cast(_I), "warm": S * (C - 1) + 2 * (S - F.col("s")) - 2})


def _by_position(x: DataFrame) -> DataFrame:
    """Turn targets given by position (in ``d.m``) into microbatch and chunk."""
    S, M, C, i = F.col("nstages"), F.col("nmicrobatches"), F.col("nchunks"), F.col("d.m")
    rest = F.greatest(M % S, F.lit(1))
    whole = _div(M, S) * S
    late = (i >= whole * C) & (M % S > 0)
    j, k = i - whole * C, i % (S * C)
    mb = F.when(late, whole + j % rest).otherwise(_div(i, S * C) * S + k % S)
    ck = F.when(late, _div(j, rest)).otherwise(_div(k, S))
    ck = F.when(F.col("d.t") == 1, C - 1 - ck).otherwise(ck)
    there = F.struct(F.col("d.t").alias("t"), F.col("d.s").alias("s"), mb.cast(_I).alias("m"), ck.cast(_I).alias("c"))
    return x.withColumn("d", F.when(F.col("d.c") == -1, there).otherwise(F.col("d")))


def _weights(t, s, m, c, S, M, C) -> list[Column]:
    """What both zero-bubble shapes share: chains over microbatches, and W after its B."""
    return [F.when(m < M - 1, _to(t, s, m + 1, c)), F.when(t == 1, _to(2, s, m, c))]


def _zb(t, s, m, c, S, M, C) -> list[Column]:
    fwd, bwd, end = t == 0, t == 1, S - 1
    return [
        *_weights(t, s, m, c, S, M, C),
        F.when(fwd & (s < end), _to(0, s + 1, m, c)),
        F.when(fwd & (s == end) & (c < C - 1), _to(0, F.lit(0), m, c + 1)),
        F.when(fwd & (s == end) & (c == C - 1), _to(1, s, m, c)),
        F.when(bwd & (s > 0), _to(1, s - 1, m, c)),
        F.when(bwd & (s == 0) & (c > 0), _to(1, end, m, c - 1)),
    ]


def _zbv(t, s, m, c, S, M, C) -> list[Column]:
    """Even chunks run down the stages and odd ones up; backwards run the other way round."""
    fwd, bwd, end = t == 0, t == 1, S - 1
    even = c % 2 == 0
    return [
        *_weights(t, s, m, c, S, M, C),
        F.when(fwd & even & (s < end), _to(0, s + 1, m, c)),
        F.when(fwd & ~even & (s > 0), _to(0, s - 1, m, c)),
        F.when(fwd & even & (s == end) & (c < C - 1), _to(0, s, m, c + 1)),
        F.when(fwd & ~even & (s == 0) & (c < C - 1), _to(0, s, m, c + 1)),
        F.when(fwd & (s == 0) & (c == C - 1), _to(1, s, m, c)),
        F.when(bwd & even & (s > 0), _to(1, s - 1, m, c)),
        F.when(bwd & ~even & (s < end), _to(1, s + 1, m, c)),
        F.when(bwd & ~even & (s == end), _to(1, s, m, c - 1)),
        F.when(bwd & even & (s == 0) & (c > 0), _to(1, s, m, c - 1)),
    ]


_RULES = {"gpipe": _gpipe, "pipedream": _pipedream, "interleaved": _interleaved, "zb": _zb, "zbv": _zbv}


def graph_edges(configs: DataFrame, schedules: Sequence[str] = SCHEDULES, strict_data_deps: bool = False) -> DataFrame:
    """Dependencies of every configuration; naming the schedules that occur keeps the plan small.

    The rules of a schedule are its semantics, asymmetries included.  With ``strict_data_deps`` the
    interleaved schedule also gets the data edges between chunks that its rules leave out.
    """
    parts = []
    for name in schedules:
        rule = _RULES[name]
        x = _keys(configs.where(F.col("schedule") == name))
        x = _with_place(x) if name == "interleaved" else x
        args = [F.col(a) for a in ("t", "s", "m", "c", "nstages", "nmicrobatches", "nchunks")]
        out = rule(*args)
        if strict_data_deps and name == "interleaved":
            t, s, m, c, S, _, C = args
            out += [
                F.when((t == 0) & (s == S - 1) & (c < C - 1), _to(0, F.lit(0), m, c + 1)),
                F.when((t == 1) & (s == 0) & (c > 0), _to(1, S - 1, m, c - 1)),
            ]
        to = x.select("graph_id", *args, F.explode(F.array(*out)).alias("d")).where(F.col("d").isNotNull())
        to = _by_position(to) if name == "interleaved" else to
        parts.append(
            to.select(
                "graph_id", _type(F.col("t")).alias("src_type"), F.col("s").alias("src_stage"), F.col("m").alias("src_mb"), F.col("c").alias("src_chk"),
                _type(F.col("d.t")).alias("dst_type"), F.col("d.s").alias("dst_stage"), F.col("d.m").alias("dst_mb"), F.col("d.c").alias("dst_chk"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*EDGE_COLS)
