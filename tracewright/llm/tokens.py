"""Encoding a corpus with a public byte-level BPE tokenizer, by tree reduction.

A text longer than one leaf is halved until its parts fit in leaves.  Leaves
are encoded alone, then neighbours are joined up the tree.  A join re-encodes
a window around the seam and widens it until the tokens outside provably stay.

Why they stay: the tokenizer first splits a text into pre-tokens and encodes each
alone.  No pre-token of its pattern runs on from a letter to a non-letter, from a
digit to a non-digit, or from another visible character to a blank or a digit, so each such place
is a border in every text that contains both characters (:data:`BORDER`).  A
window that begins and ends at such places, one on either side of the
seam, can be encoded by itself, and nothing outside it changes.  Joining is
therefore exact and associative: nodes form a monoid with the empty text as unit.
A node in which no border was found yet stays unencoded until it meets one,
so a very long unbroken string is encoded once.  Decoding concatenates the bytes
of the children.

Defined cases: null and empty texts give the empty list; text that looks like
a special token is plain text; very long unbroken strings are encoded whole;
no text is cut; repeated rows are encoded each; extra columns are ignored unless carried.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.plans.names import carried

#: Folder of the public vocabulary files; never copied into this repository.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Splitting pattern of the byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Places at which PATTERN always ends a pre-token: between the two characters.
BORDER = r"\p{L}\P{L}|\p{N}\P{N}|[^\s\p{L}\p{N}][\s\p{N}]"
#: Characters in a leaf.
LEAF = 1024
#: First window on either side of a seam, in characters.
WINDOW = 32


@functools.cache
def encoder(path: str):
    """The tokenizer of a ``.tiktoken`` ranks file, without special tokens; one per worker process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _border():
    import regex

    return regex.compile(BORDER), regex.compile(rf"(?r){BORDER}")


class Node(NamedTuple):
    """A text and its ids; no ids yet where no border was found in it."""

    text: str
    ids: list[int] | None


def _last_border(text: str) -> int:
    """The last place known to be a border, 0 if there is none; the searched window doubles."""
    width = WINDOW
    while True:
        begin = max(0, len(text) - width)
        m = _border()[1].search(text, begin)
        if m:
            return m.start() + 1
        if not begin:
            return 0
        width *= 2


def _first_border(text: str) -> int:
    """The first place known to be a border, the text's length if there is none."""
    width = WINDOW
    while True:
        m = _border()[0].search(text, 0, width)
        if m:
            return m.start() + 1
        if width >= len(text):
            return len(text)
        width *= 2


def join(enc, a: Node, b: Node) -> Node:
    """The node of the concatenated text; only a window around the seam is encoded again."""
    if not a.text:
        return b
    if not b.text:
        return a
    i, j = _last_border(a.text), _first_border(b.text)
    if i == 0 and j == len(b.text):
        return Node(a.text + b.text, None)
    ids = enc.encode_ordinary(a.text[i:] + b.text[:j])
    if i:
        left = enc.encode_ordinary(a.text) if a.ids is None else a.ids
        ids = left[: len(left) - len(enc.encode_ordinary(a.text[i:]))] + ids
    if j < len(b.text):
        right = enc.encode_ordinary(b.text) if b.ids is None else b.ids
        ids = ids + right[len(enc.encode_ordinary(b.text[:j])) :]
    return Node(a.text + b.text, ids)


def tree(enc, text: str, leaf_size: int = LEAF) -> Node:
    """Encode halves, then join them."""
    if len(text) <= leaf_size:
        return Node(text, enc.encode_ordinary(text))
    half = len(text) // 2
    return join(enc, tree(enc, text[:half], leaf_size), tree(enc, text[half:], leaf_size))


def encode(enc, text: str | None, leaf_size: int = LEAF) -> list[int]:
    """Ids of a text, null or not."""
    if not text:
        return []
    node = tree(enc, text, leaf_size)
    return enc.encode_ordinary(text) if node.ids is None else node.ids


def _bytes(enc, ids: list[int], leaf_size: int) -> bytes:
    if len(ids) <= leaf_size:
        return enc.decode_bytes(ids)
    half = len(ids) // 2
    return _bytes(enc, ids[:half], leaf_size) + _bytes(enc, ids[half:], leaf_size)


def decode(enc, ids: list[int], leaf_size: int = LEAF) -> str:
    """The text of ids: bytes of the halves are concatenated up the tree (a character may lie in both)."""
    return _bytes(enc, ids, leaf_size).decode("utf-8", errors="replace")


def encode_column(df: DataFrame, text: str, carry: list[str], *, ids: str = "ids", vocabulary: str = "byte_bpe_50k", leaf_size: int = LEAF, counts_only: bool = False) -> DataFrame:
    """(carry..., ids): ids of each text; with ``counts_only`` their number instead, as ``n_tokens``."""
    path = f"{TOKENIZER_DIR}/{vocabulary}.tiktoken"
    kept = carried(carry, ["n_tokens" if counts_only else ids])
    source = df.select(*[F.col(c).alias(n) for c, n in zip(carry, kept, strict=True)], F.col(text).alias("__text"))
    out = T.StructField("n_tokens", T.LongType()) if counts_only else T.StructField(ids, T.ArrayType(T.IntegerType()))
    schema = T.StructType([*source.schema.fields[: len(carry)], out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            got = [encode(enc, t, leaf_size) for t in batch["__text"].to_pylist()]
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            if counts_only:
                col: pa.Array = pa.array(sizes)
            else:
                flat = np.fromiter((i for g in got for i in g), np.int32, int(sizes.sum()))
                col = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], col], names=[*kept, out.name])

    return source.mapInArrow(run, schema)


def decode_column(df: DataFrame, ids: str, carry: list[str], *, text: str = "text", vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """(carry..., text): the text of each list of ids; null lists give null."""
    path = f"{TOKENIZER_DIR}/{vocabulary}.tiktoken"
    kept = carried(carry, [text])
    source = df.select(*[F.col(c).alias(n) for c, n in zip(carry, kept, strict=True)], F.col(ids).alias("__ids"))
    schema = T.StructType([*source.schema.fields[: len(carry)], T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = [None if x is None else decode(enc, x) for x in batch["__ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.array(texts, pa.string())], names=[*kept, text])

    return source.mapInArrow(run, schema)
