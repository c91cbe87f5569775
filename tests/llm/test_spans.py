import random

import numpy as np
import pytest

from tracewright.llm import spans
from tracewright.llm.spans import anchors, extended, shared_share, shared_spans, window_hashes
from tracewright.plans import durable


def _brute(docs, length):
    seen = {}
    for i, t in docs:
        for j in range(len(t or "") - length + 1):
            seen.setdefault(t[j : j + length], set()).add(i)
    out = set()
    for i, t in docs:
        spans = []
        for j in range(len(t or "") - length + 1):
            if len(seen[t[j : j + length]]) > 1:
                if spans and j <= spans[-1][1]:
                    spans[-1][1] = j + length
                else:
                    spans.append([j, j + length])
        out |= {(i, *s) for s in spans}
    return sorted(out)


def _corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh é中🙂") for _ in range(r.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    common = [text(12) for _ in range(4)]
    docs = []
    for i in range(60):
        parts = [text(r.randrange(3, 15))]
        for _ in range(r.randrange(3)):
            c = r.choice(common)
            a = r.randrange(len(c) // 2)
            parts += [c[a : a + r.randrange(10, len(c))], text(2)]
        docs.append((i, "".join(parts)))
    docs += [(100, docs[0][1]), (101, docs[0][1]), (102, "z" * 300), (103, "z" * 200), (104, "y" * 300), (105, "xy" * 90), (106, "xy" * 70), (107, None), (108, ""), (109, "short")]
    return docs


@pytest.mark.parametrize(("length", "hot", "hot_rows", "levels", "wide"), [(20, 20_000, 100_000, 2, 1), (20, 1, 2, 1, 0), (31, 20_000, 1, 3, 0), (31, 3, 100_000, 2, 1), (5, 2, 2, 2, 0)])
def test_agrees_with_brute_force(spark, monkeypatch, length, hot, hot_rows, levels, wide):
    monkeypatch.setattr(spans, "LEVELS", levels)
    if not wide:  # no broadcasts
        monkeypatch.setattr(durable, "BROADCAST_BYTES", 1)
    docs = _corpus(length)
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in [*docs, *docs[:5]]], "doc_id long, text string, h int, ctx string")
    got = shared_spans(df, "doc_id", "text", min_len=length, hot=hot, hot_rows=hot_rows)
    assert sorted(tuple(r) for r in got.collect()) == _brute(docs, length)
    shares = {r["doc_id"]: r for r in shared_share(df, "doc_id", "text", got).collect()}
    assert shares[100]["shared_share"] == 1.0 and shares[107]["shared_share"] == 0.0 and len(shares) == len(docs)


def test_repeats_within_a_document_do_not_count(spark):
    t = "".join(chr(97 + i * i % 23) for i in range(200))
    df = spark.createDataFrame([(1, t + "#" + t), (1, t + "#" + t)], "doc_id long, text string")
    assert shared_spans(df, "doc_id", "text").count() == 0
    assert shared_spans(df.limit(0), "doc_id", "text").count() == 0


def test_hashes_do_not_depend_on_place():
    x = np.frombuffer(("abcdefghij" * 9).encode("utf-32-le"), np.uint32)
    h = window_hashes(x, 17)
    assert (h[:10] == h[10:20]).all() and len(set(h.tolist())) == 10


def test_every_long_window_has_an_anchor():
    r = random.Random(4)
    t = "".join(r.choice("abcd") for _ in range(900))
    codes = np.frombuffer(t.encode("utf-32-le"), np.uint32)
    d, h, p, lo, hi = anchors(codes, np.array([0, 400]), np.array([400, 500]), 40, 20)
    covered = {(k, w) for k, a, b in zip(d.tolist(), lo.tolist(), hi.tolist(), strict=True) for w in range(a, b + 1)}
    assert covered == {(0, w) for w in range(361)} | {(1, w) for w in range(461)}
    assert all(lo <= p) and all(p + 20 <= lo + 40)


def test_extensions_cover_all_windows_by_their_offset_alone():
    for min_len in range(2, 80):
        length = -(-min_len // 4)
        while 2 * length < min_len:
            for p, lo, hi in ((100, 100 - (min_len - length), 100), (100, 95, 97), (100, 100, 100)):
                lo = max(lo, p - (min_len - length))
                got = {}
                for who, q, a, b in zip(*[x.tolist() for x in extended(*[np.array([x]) for x in (p, lo, hi)], length, min_len)], strict=True):
                    assert who == 0
                    for s in range(a, b + 1):
                        assert s <= q <= q + 2 * length <= s + min_len and q <= p and p + length <= q + 2 * length
                        got[s] = q
                assert sorted(got) == list(range(lo, hi + 1))
            length *= 2
