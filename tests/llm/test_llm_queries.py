"""Every registered training-data query against its SQL, or against what must hold of it."""

import pytest

from tests.oracle import SF, compare
from tracewright.llm import queries, tokens
from tracewright.plans.durable import load


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLE[name])


def test_ids_are_those_of_the_tokenizer(spark):
    texts = {r["doc_id"]: r["text"] for r in load(spark, SF, "documents").collect()}
    got = {r["doc_id"]: r["ids"] for r in queries.p7_ids(spark, SF).collect()}
    encoding = tokens.encoder(f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.tiktoken")
    assert got == {i: encoding.encode_ordinary(t) if t else [] for i, t in texts.items()}


def test_a_mixture_keeps_its_caps_and_its_report(spark):
    docs = {r["doc_id"]: r for r in load(spark, SF, "documents").collect()}
    goals = {r["source"].strip().lower(): r for r in load(spark, SF, "mix_targets").collect()}
    encoding = tokens.encoder(f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.tiktoken")
    size = {i: len(encoding.encode_ordinary(r["text"] or "")) for i, r in docs.items()}
    source = {i: (r["source"] or "").strip().lower() for i, r in docs.items()}
    total, by_source = sum(size.values()), {}
    for r in queries.p8_mix(spark, SF).collect():
        i = r["doc_id"]
        assert r["n_tokens"] == size[i] > 0 and r["source"] == source[i] and 1 <= r["repeats"] <= goals[source[i]]["max_repeats"]
        assert i not in by_source.setdefault(source[i], {})
        by_source[source[i]][i] = r["repeats"]
    report = {r["source"]: r for r in queries.p8_shares(spark, SF).collect()}
    assert set(report) == set(goals)
    chosen = sum(r["reached_tokens"] for r in report.values())
    for s, r in report.items():
        used = by_source.get(s, {})
        reached = sum(size[i] * k for i, k in used.items())
        most = goals[s]["max_repeats"] * sum(n for i, n in size.items() if source[i] == s)
        assert (r["reached_tokens"], r["documents"]) == (reached, len(used))
        assert r["reached_share"] == pytest.approx(reached / chosen) and r["reached_of_total"] == pytest.approx(reached / total)
        assert r["short"] == (most < r["target_tokens"])
        if r["short"]:
            assert reached == most
        else:  # no further off than one document
            assert abs(reached - r["target_tokens"]) <= max(n for i, n in size.items() if source[i] == s)
    assert {r["source"] for r in queries.p8_found(spark, SF).collect()} == {s for s, r in report.items() if r["short"]}


def test_every_query_is_tested():
    assert set(queries.QUERIES) - set(queries.ORACLE) == {"p7_ids", "p8_mix", "p8_shares", "p8_found"}
