import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import tokens as K

PATH = f"{K.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")
_BITS = ["'", "ll", "s", " ", "  ", "\n", "\r\n", "\t", "a", "Z", "7", "é", "é", "中文", "🙂", "​", " ", "!?", "<|endoftext|>", "re", "'re"]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(_BITS), max_size=60).map("".join), st.text(max_size=80)), st.integers(1, 9))
def test_tree_is_exact(text, leaf):
    enc = K.encoder(PATH)
    whole = enc.encode_ordinary(text)
    assert K.encode(enc, text, leaf) == whole
    assert K.decode(enc, whole, leaf) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(_BITS), max_size=12).map("".join), min_size=3, max_size=3))
def test_joining_is_associative(parts):
    enc = K.encoder(PATH)
    a, b, c = (K.Node(t, enc.encode_ordinary(t)) for t in parts)
    ids = lambda n: enc.encode_ordinary(n.text) if n.ids is None else n.ids
    assert ids(K.join(enc, K.join(enc, a, b), c)) == ids(K.join(enc, a, K.join(enc, b, c))) == enc.encode_ordinary("".join(parts))
    unit = K.Node("", [])
    assert ids(K.join(enc, unit, a)) == ids(K.join(enc, a, unit)) == ids(a)


def test_agrees_with_another_library():
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{K.TOKENIZER_DIR}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    texts = ["".join(_BITS[i % len(_BITS)] for i in range(k, k + 300, k + 1)) for k in range(20)]
    assert [K.encode(K.encoder(PATH), t, 64) for t in texts] == [e.ids for e in other.encode_batch(texts, add_special_tokens=False)]


def test_very_long_strings():
    enc = K.encoder(PATH)
    assert K.decode(enc, K.encode(enc, "ab" * 60_000)) == "ab" * 60_000
    assert K.encode(enc, " " * 30_000 + "x" * 3000) == enc.encode_ordinary(" " * 30_000 + "x" * 3000)


def test_column(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "a <|endoftext|> b", None), (3, "a <|endoftext|> b", None)], "doc_id long, text string, ids string")
    rows = K.encode_column(df, "text", ["doc_id", "ids"]).orderBy("doc_id").collect()
    want = K.encoder(PATH).encode_ordinary("a <|endoftext|> b")
    assert [(r["doc_id"], r["ids_"], r["ids"]) for r in rows] == [(1, "a", []), (2, "b", []), (3, None, want), (3, None, want)]
    assert [r["n_tokens"] for r in K.encode_column(df, "text", ["doc_id"], counts_only=True).orderBy("doc_id").collect()] == [0, 0, len(want), len(want)]
    assert K.encode_column(df.limit(0), "text", ["doc_id"]).count() == 0
    back = K.decode_column(K.encode_column(df, "text", ["doc_id"]), "ids", ["doc_id"]).orderBy("doc_id").collect()
    assert [r["text"] for r in back] == ["", "", "a <|endoftext|> b", "a <|endoftext|> b"]
