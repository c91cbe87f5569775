"""Mixing sources to target weights, by cube-method balanced sampling.

Every source has a target of ``target_share`` times the size of the whole
corpus.  A source that cannot reach it, with all documents used ``max_repeats`` times, is used
up to that and reported short.  Of any other source each document is used a
whole number of times and a balanced sample of its documents once
more.  The sample is drawn by the cube method: inclusion probabilities move through the null
space of the constraints (size in tokens, number of documents), three
documents at a time, until each is 0 or 1 or no move is left.

The flight runs in blocks of documents spread by hash, which leave at most
two open documents each; the open ones meet in ever fewer blocks until one per source
remains, whose at most two open documents are settled by trying all landings.
No step sees more than a block, and all documents take part.

Defined cases: sources are compared trimmed and in lower case; a document
without tokens or without a target source is never used; a source of the
targets without documents is short; repeated targets of one source
are refused; an empty corpus reaches nothing; the draw depends on ids and seed only.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.plans.durable import broadcast_if_small, cut

#: Documents in a block of the flight phase.
BLOCK = 8192
#: Open documents a block can leave behind: one per constraint.
OPEN = 2


def fly(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Flight phase for the constraints (size, 1): all but two probabilities become 0 or 1, both totals stay."""
    p = p.astype(float).copy()
    eps = 1e-9
    todo = [i for i in range(len(p)) if eps < p[i] < 1 - eps]
    held: list[int] = []
    k = 0
    while True:
        while len(held) < 3 and todo:
            held.append(todo.pop())
        if len(held) == 3:
            a, b, c = (size[i] for i in held)
            move = (b - c, c - a, a - b) if not a == b == c else (1.0, -1.0, 0.0)
        elif len(held) == 2 and size[held[0]] == size[held[1]]:
            move = (1.0, -1.0)
        else:
            return p
        up = down = np.inf
        for i, m in zip(held, move, strict=True):
            if m > 0:
                up, down = min(up, (1 - p[i]) / m), min(down, p[i] / m)
            elif m < 0:
                up, down = min(up, p[i] / -m), min(down, (1 - p[i]) / -m)
        step = up if draws[k % len(draws)] * (up + down) < down else -down
        k += 1
        for i, m in zip(held, move, strict=True):
            p[i] += step * m
            if p[i] <= eps or p[i] >= 1 - eps:
                p[i] = round(p[i])
        held = [i for i in held if 0 < p[i] < 1]


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Landing: of all roundings of the open documents, the one nearest to the size still to be placed."""
    p = p.copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    want = float((p[left] * size[left]).sum())
    best = min(itertools.product((0.0, 1.0), repeat=len(left)), key=lambda c: (abs(float(np.dot(c, size[left])) - want), c))
    p[left] = best
    return p


def _flight(seed: int, last: bool):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "doc_id"], kind="stable").reset_index(drop=True)
        size = pdf["n_tokens"].to_numpy(float)
        draws = np.random.default_rng([seed, len(pdf), int(pdf["order"].iloc[0]) & 0x7FFFFFFF]).random(max(1, len(pdf)))
        p = fly(pdf["p"].to_numpy(float), size, draws)
        pdf["p"] = land(p, size) if last else p
        return pdf

    return run


def mix(docs: DataFrame, targets: DataFrame, *, seed: int = 1, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(chosen, report) from docs(doc_id, source, n_tokens) and targets(source, target_share, max_repeats).

    chosen: doc_id, source, n_tokens, repeats.  report: source, target_share,
    target_tokens, reached_tokens, reached_share (of all that is chosen), reached_of_total (of the tokens of all
    documents, as target_share is), documents, short.
    """
    name = lambda c: F.lower(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")))
    goals = targets.select(name(F.col("source")).alias("source"), "target_share", "max_repeats")
    n_goals, n_names = goals.agg(F.count(F.lit(1)), F.countDistinct(F.coalesce(F.concat(F.lit("."), "source"), F.lit("")))).first()
    if n_names < n_goals:
        raise ValueError("a source is named twice in the targets")
    docs = docs.select("doc_id", name(F.col("source")).alias("source"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    per_source = docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.when(F.col("n_tokens") > 0, 1)).alias("usable"))
    plan = goals.join(per_source, "source", "left").fillna(0, ["tokens", "usable"])
    all_tokens = docs.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    want = F.col("target_share") * F.lit(all_tokens)
    plan = (
        plan.withColumn("target_tokens", want)
        .withColumn("short", F.col("tokens") * F.col("max_repeats") < want)
        .withColumn("times", F.when(F.col("tokens") > 0, F.least(want / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0))
        .withColumn("base", F.floor("times").cast("int"))
        .withColumn("p", F.col("times") - F.col("base"))
    )
    plan = cut(plan)
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("usable") / block)).cast("int")
    units = (
        docs.where(F.col("n_tokens") > 0)
        .join(broadcast_if_small(plan.select("source", "base", "p", n_blocks.alias("blocks")), n_goals), "source")
        .withColumn("order", F.xxhash64("doc_id", F.lit(seed)))
        .withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), "blocks").cast("int"))
    )
    whole = units.where((F.col("p") <= 0) | (F.col("p") >= 1)).select("doc_id", "source", "n_tokens", (F.col("base") + F.col("p").cast("int")).alias("repeats"))
    open_ = units.where((F.col("p") > 0) & (F.col("p") < 1)).select("doc_id", "source", "n_tokens", "base", "order", "block", "p")
    done = [whole]
    most = plan.agg(F.max("usable")).first()[0] or 0
    blocks = max(1, -(-most // block))
    while True:
        last = blocks == 1
        flown = open_.groupBy("source", "block").applyInPandas(_flight(seed, last), open_.schema)
        if last:
            done.append(flown.select("doc_id", "source", "n_tokens", (F.col("base") + F.round("p").cast("int")).alias("repeats")))
            break
        flown = cut(flown)
        settled = (F.col("p") == 0) | (F.col("p") == 1)
        done.append(flown.where(settled).select("doc_id", "source", "n_tokens", (F.col("base") + F.col("p").cast("int")).alias("repeats")))
        fan = block // OPEN
        blocks = -(-blocks // fan)
        open_ = flown.where(~settled).withColumn("block", F.expr(f"block div {fan}").cast("int") if blocks > 1 else F.lit(0))
    chosen = done[0]
    for d in done[1:]:
        chosen = chosen.unionByName(d)
    chosen = cut(chosen.where(F.col("repeats") > 0))
    used = chosen.groupBy("source").agg(F.sum(F.col("repeats") * F.col("n_tokens")).alias("reached_tokens"), F.count(F.lit(1)).alias("documents"))
    total = chosen.agg(F.coalesce(F.sum(F.col("repeats") * F.col("n_tokens")), F.lit(0))).first()[0]
    share = F.col("reached_tokens") / F.lit(total) if total else F.lit(0.0)
    report = (
        plan.join(used, "source", "left")
        .fillna(0, ["reached_tokens", "documents"])
        .select(
            "source", "target_share", "target_tokens", "reached_tokens",
            share.alias("reached_share"), (F.col("reached_tokens") / F.lit(all_tokens) if all_tokens else F.lit(0.0)).alias("reached_of_total"), "documents",
            # short: everything is used as often as allowed, and it is not enough
            (F.col("short") & (F.col("reached_tokens") < F.col("target_tokens"))).alias("short"),
        )
    )
    return chosen, report
