"""Long exact spans shared between documents, by level-wise doubling.

The first level is windows of a quarter of ``min_len``.  A span of ``min_len`` characters contains at least one of those that
minimizer sampling keeps (in every run of neighbouring windows the one with the smallest hash, the leftmost of equals), and
an equal span contains the same one at the same offset.  At each level windows are compared by hash over all
documents; those found in one document alone are dropped, and the text around each survivor is extended to a window of twice
the length (:func:`extended`), until no candidates survive or the next length is ``min_len``.

There, around each survivor, all windows of ``min_len`` that contain it are compared.  Together they are a short stretch of text, its
*context*, and equal windows can only meet among contexts of one survivor hash.  Equal contexts are collapsed with the
extremes of their document ids; what is shared as a whole is settled there, and
only distinct contexts are compared window by window.  A survivor hash with many
distinct contexts is hot and is compared by window hash over the whole cluster; a context with many occurrences is hot and settled
without a shuffle of them.  Longer windows than ``min_len`` are not formed: a longer shared span is covered by shared windows
of ``min_len``, which overlap and so merge into it.  No pairs of documents are formed at any level.

Defined cases: null, empty and short texts share nothing; repeats within one
document do not count; equal documents share their whole text; repeated rows
of one document count as that document; offsets are Unicode code points, the end exclusive; windows are told
apart by 64-bit hashes below ``min_len`` and by 96-bit hashes there; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.plans.durable import broadcast_if_small, cut, discard
from tracewright.plans.skew import HOT_ROWS, keep_keys

MIN_LEN = 150
#: Characters handled at once; a longer document is handled alone.
CHUNK = 1 << 19
#: Contexts gathered before an Arrow batch is sent on.
FLUSH = 20_000
#: A survivor hash with more distinct contexts is compared across the cluster.
HOT = 20_000
#: The first level is min_len / 2**LEVELS, so there are as many doublings.
LEVELS = 2
_POS_BITS = 31
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        b = int(_BASES[which])
        size = max(n, CHUNK * 2)
        up, down = np.full(size, b, np.uint64), np.full(size, pow(b, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _powers[which] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return have


def window_hashes(codes: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hashes of all windows of ``length`` code points; equal windows have equal hashes wherever they stand."""
    n = len(codes)
    if n < length:
        return np.empty(0, np.uint64)
    up, down = _power(which, n)
    value = _mix(codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019 + which))
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(value * up[:n], out=prefix[1:])
    return _mix((prefix[length:] - prefix[:-length]) * down[: n - length + 1])


def _slide_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def anchors(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, min_len: int, length: int) -> tuple[np.ndarray, ...]:
    """(document, hash, position, first window, last window) of the sampled windows of ``length``.

    ``codes`` holds documents one after the other; positions are relative to their document; first and last
    window are the starts of the neighbouring windows of ``min_len`` whose sample it is.
    """
    width = min_len - length + 1
    empty = (np.empty(0, np.int64), np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    if len(codes) < min_len:
        return empty
    grams = window_hashes(codes, length)
    low = np.uint64((1 << _POS_BITS) - 1)
    packed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    best = (_slide_min(packed, width) & low).astype(np.int64)  # one per window of min_len
    doc = np.repeat(np.arange(len(sizes)), sizes)[: len(best)]
    inside = np.arange(len(best)) + min_len <= (starts + sizes)[doc]
    at = np.flatnonzero(inside)
    if not len(at):
        return empty
    b, d = best[at], doc[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (b[1:] != b[:-1]) | (d[1:] != d[:-1])
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:] - 1, len(at) - 1)
    d = d[head]
    off = starts[d]
    return d, grams[b[head]], b[head] - off, at[head] - off, at[tail] - off


def _chunks(texts: list[str | None], min_len: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, code points, starts, sizes) of texts long enough, in groups of about CHUNK characters."""
    rows: list[int] = []
    total = 0
    for i, t in enumerate([*texts, None]):
        last = i == len(texts)
        if rows and (last or total >= CHUNK):
            joined = "".join(texts[r] for r in rows)
            sizes = np.array([len(texts[r]) for r in rows], np.int64)
            yield rows, np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(sizes) - sizes, sizes
            rows, total = [], 0
        if not last and t is not None and len(t) >= min_len:
            rows.append(i)
            total += len(t)


_LONG, _INT, _STR = T.LongType(), T.IntegerType(), T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_MARK = _struct(doc_id=_LONG, h=_LONG, p=_INT, lo=_INT, hi=_INT)


def _anchor_rows(docs: DataFrame, min_len: int, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch["text"].to_pylist(), batch["doc_id"].to_numpy(zero_copy_only=False)
            for rows, codes, starts, sizes in _chunks(texts, min_len):
                d, h, p, lo, hi = anchors(codes, starts, sizes, min_len, length)
                cols = [pa.array(ids[np.array(rows)[d]], pa.int64()), pa.array(h.view(np.int64)), *[pa.array(x.astype(np.int32)) for x in (p, lo, hi)]]
                yield pa.RecordBatch.from_arrays(cols, names=_MARK.names)

    return docs.mapInArrow(run, _MARK)


def extended(p: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int, min_len: int) -> tuple[np.ndarray, ...]:
    """The windows of twice ``length`` around those at ``p``: whose, position, first window, last window.

    For the windows of ``min_len`` in which it fits to the right it is extended that way, for the others to the left; which
    of the two depends on the offset within the window only, so equal windows have equal extensions.
    """
    turn = p + 2 * length - min_len  # the first window in which the extension to the right fits
    right, left = np.flatnonzero(hi >= turn), np.flatnonzero(lo < turn)
    both = lambda a, b: np.concatenate([a[right], b[left]])
    return np.concatenate([right, left]), both(p, p - length), both(np.maximum(lo, turn), lo), both(hi, np.minimum(hi, turn - 1))


def _extended_rows(docs: DataFrame, min_len: int, length: int) -> DataFrame:
    """The survivors of ``length`` in ``marks``, extended to twice of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, marks = batch["text"].to_pylist(), batch["doc_id"].to_numpy(zero_copy_only=False), batch["marks"]
            of, offsets = marks.values, marks.offsets.to_numpy()
            columns = [of.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("p", "lo", "hi")]
            for rows, codes, starts, _ in _chunks(texts, min_len):
                sizes = offsets[np.array(rows) + 1] - offsets[rows]
                own = np.repeat(np.arange(len(rows)), sizes)
                at = np.concatenate([np.arange(offsets[r], offsets[r + 1]) for r in rows])
                who, p, lo, hi = extended(*[c[at] for c in columns], length, min_len)
                h = window_hashes(codes, 2 * length)[starts[own[who]] + p]
                doc = ids[np.array(rows)[own[who]]]
                cols = [pa.array(doc, pa.int64()), pa.array(h.view(np.int64)), *[pa.array(x.astype(np.int32)) for x in (p, lo, hi)]]
                yield pa.RecordBatch.from_arrays(cols, names=_MARK.names)

    return docs.mapInArrow(run, _MARK)


def _survivors(texts: DataFrame, sampled: DataFrame) -> DataFrame | None:
    """(doc_id, text, marks) of the windows that stand in two documents; None if there are none."""
    seen = sampled.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count(F.lit(1)).alias("n"))
    repeated = cut(seen.where(F.col("a") < F.col("b")).select("h", "n"))
    n_repeated = repeated.count()
    if not n_repeated:
        return None
    alive = keep_keys(sampled, repeated, "h", n_repeated, "n")
    marks = cut(alive.groupBy("doc_id").agg(F.collect_set(F.struct("h", "p", "lo", "hi")).alias("marks")))  # bounded by one text
    n_docs, n_marks = marks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("marks")), F.lit(0))).first()
    return texts.join(broadcast_if_small(marks, n_docs, 64 + 48 * n_marks // n_docs), "doc_id")


def _context_rows(docs: DataFrame, min_len: int) -> DataFrame:
    """One row per surviving anchor: its hash, windows, and the text they span."""
    schema = _struct(doc_id=_LONG, h=_LONG, shift=_INT, lo=_INT, hi=_INT, ctx=T.BinaryType(), text=_STR)

    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())

    def flush(cols: list[list]) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=schema.names)
        for c in cols:
            c.clear()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[] for _ in schema.names]
        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, text = batch["doc_id"][i].as_py(), batch["text"][i].as_py()
                for m in batch["marks"][i].as_py():
                    part = text[m["lo"] : m["hi"] + min_len]
                    shift = m["p"] - m["lo"]
                    key = xxhash.xxh3_128_digest(f"{m['h']}:{shift}:{part}".encode("utf-8", "surrogatepass"))
                    for c, v in zip(cols, (doc_id, m["h"], shift, m["lo"], m["hi"], key, part), strict=True):
                        c.append(v)
                if len(cols[0]) >= FLUSH:
                    yield flush(cols)
        if cols[0]:
            yield flush(cols)

    return docs.mapInArrow(run, schema)


def _windows_of(texts: list[str], min_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, offset, hash, second hash) of every window of every context."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum(sizes) - sizes
    h1, h2 = window_hashes(codes, min_len), window_hashes(codes, min_len, 1)
    who = np.repeat(np.arange(len(texts)), sizes)[: len(h1)]
    off = np.arange(len(h1)) - starts[who]
    ok = off + min_len <= sizes[who]
    return who[ok], off[ok], h1[ok].view(np.int64), (h2[ok] >> np.uint64(32)).astype(np.int64)


def _runs(who: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring offsets, input in order of (who, off)."""
    if not len(who):
        return who, off, off
    fresh = np.ones(len(who), bool)
    fresh[1:] = (who[1:] != who[:-1]) | (off[1:] != off[:-1] + 1)
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:] - 1, len(who) - 1)
    return who[head], off[head], off[tail]


def _compare_cold(contexts: DataFrame, min_len: int) -> DataFrame:
    """Windows repeated among the contexts of one survivor hash; input grouped by hash."""
    schema = _struct(ctx=T.BinaryType(), first=_INT, last=_INT)

    def settle(table: pa.Table) -> pa.RecordBatch:
        h = table["h"].to_numpy()
        near = np.append(h[1:] == h[:-1], False)
        table = table.filter(pa.array(near | np.append(False, near[:-1])))  # a survivor with one context has nothing to compare
        if not table.num_rows:
            return pa.RecordBatch.from_pylist([], schema=pa.schema([("ctx", pa.binary()), ("first", pa.int32()), ("last", pa.int32())]))
        who, off, h1, h2 = _windows_of(table["text"].to_pylist(), min_len)
        low, high = table["mn"].to_numpy()[who], table["mx"].to_numpy()[who]
        order = np.lexsort((h2, h1))
        s1, s2 = h1[order], h2[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
        head = np.flatnonzero(fresh)
        shared = np.minimum.reduceat(low[order], head) < np.maximum.reduceat(high[order], head)
        hit = np.zeros(len(order), bool)
        hit[order] = np.repeat(shared, np.diff(np.append(head, len(order))))
        hit &= (table["mn"].to_numpy() == table["mx"].to_numpy())[who]  # the others are settled as a whole
        w, a, b = _runs(who[hit], off[hit])
        ctx = table["ctx"].combine_chunks().take(pa.array(w))
        return pa.RecordBatch.from_arrays([ctx, pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            h = table["h"].to_numpy()
            at = int(np.flatnonzero(h == h[-1])[0])
            if at:
                yield settle(table.slice(0, at))
            held = table.slice(at)  # at most HOT contexts
        if held is not None:
            yield settle(held)

    return contexts.repartition("h").sortWithinPartitions("h").mapInArrow(run, schema)


def _compare_hot(contexts: DataFrame, min_len: int) -> DataFrame:
    """The same, by window hash over the cluster."""
    schema = _struct(ctx=T.BinaryType(), off=_INT, h1=_LONG, h2=_LONG, mn=_LONG, mx=_LONG)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                who, off, h1, h2 = _windows_of(part["text"].to_pylist(), min_len)
                at = pa.array(who)
                yield pa.RecordBatch.from_arrays(
                    [part["ctx"].take(at), pa.array(off.astype(np.int32)), pa.array(h1), pa.array(h2), part["mn"].take(at), part["mx"].take(at)],
                    names=schema.names,
                )

    windows = cut(contexts.select("ctx", "text", "mn", "mx").mapInArrow(run, schema))  # read twice
    shared = windows.groupBy("h1", "h2").agg(F.min("mn").alias("a"), F.max("mx").alias("b")).where(F.col("a") < F.col("b")).select("h1", "h2")
    hits = windows.where(F.col("mn") == F.col("mx")).join(shared, ["h1", "h2"], "left_semi")
    w = Window.partitionBy("ctx").orderBy("off")  # a context has at most half of min_len windows
    return (
        hits.withColumn("__run", F.col("off") - F.row_number().over(w))
        .groupBy("ctx", "__run")
        .agg(F.min("off").alias("first"), F.max("off").alias("last"))
        .select("ctx", "first", "last")
    )


def shared_spans(docs: DataFrame, doc_id: str, text: str, *, min_len: int = MIN_LEN, hot: int = HOT, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, span_start, span_end): maximal stretches covered by spans of ``min_len`` that stand in another document too."""
    if min_len < 2:
        raise ValueError("min_len must be at least 2")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull())
    length = -(-min_len // (1 << LEVELS))
    sampled = cut(_anchor_rows(texts, min_len, length))
    alive = _survivors(texts, sampled)
    while alive is not None and 2 * length < min_len:
        before, sampled = sampled, cut(_extended_rows(alive, min_len, length))
        discard(before)
        length *= 2
        alive = _survivors(texts, sampled)
    if alive is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, span_start int, span_end int")
    # all windows of min_len around the survivors
    around = cut(_context_rows(alive, min_len))
    seen = around.groupBy("h", "ctx").agg(F.min("doc_id").alias("mn"), F.max("doc_id").alias("mx"), F.count(F.lit(1)).alias("n"), F.min("text").alias("text"))
    contexts = cut(seen)
    many = cut(contexts.groupBy("h").count().where(F.col("count") > hot).select("h"))
    n_many = many.count()  # at most contexts / hot
    cold = contexts.join(broadcast_if_small(many, n_many), "h", "left_anti") if n_many else contexts
    found = _compare_cold(cold, min_len)
    if n_many:
        found = found.unionByName(_compare_hot(contexts.join(broadcast_if_small(many, n_many), "h", "left_semi"), min_len))
    whole = contexts.where(F.col("mn") < F.col("mx"))
    often = cut(whole.where(F.col("n") > hot_rows).select("ctx"))
    n_often = often.count()  # at most contexts / hot_rows
    span = lambda df, first, last: df.select("doc_id", (F.col("lo") + first).alias("s"), (last + min_len).alias("e"))
    bare = around.select("doc_id", "ctx", "lo", "hi")
    pieces = []
    if n_often:
        side = broadcast_if_small(often, n_often)
        pieces.append(span(bare.join(side, "ctx", "left_semi"), F.lit(0), F.col("hi")))
        bare, whole = bare.join(side, "ctx", "left_anti"), whole.join(side, "ctx", "left_anti")
    settled = found.unionByName(whole.select("ctx", F.lit(0).alias("first"), F.lit(None).cast("int").alias("last")))
    pieces.append(span(bare.join(settled, "ctx"), F.col("first"), F.coalesce(F.col("lo") + F.col("last"), "hi")))
    spans = reduce(DataFrame.unionByName, pieces).groupBy("doc_id", "s").agg(F.max("e").alias("e"))
    w = Window.partitionBy("doc_id").orderBy("s")  # bounded by one text
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("__new", F.coalesce((F.col("s") > reach).cast("int"), F.lit(1))).withColumn("__k", F.sum("__new").over(w))
    return (
        islands.groupBy("doc_id", "__k")
        .agg(F.min("s").cast("int").alias("span_start"), F.max("e").cast("int").alias("span_end"))
        .drop("__k")
    )


def shared_share(docs: DataFrame, doc_id: str, text: str, spans: DataFrame) -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_share) of every document."""
    covered = spans.groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    sizes = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).alias("n_chars")).dropDuplicates(["doc_id"])
    shared = F.coalesce("shared_chars", F.lit(0))
    return sizes.join(covered, "doc_id", "left").select(
        "doc_id", "n_chars", shared.alias("shared_chars"),
        F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(0.0).alias("shared_share"),
    )
