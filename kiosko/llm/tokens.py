"""Encoding of a corpus with a public byte-level BPE tokenizer.

A text is cut into pieces by the tokenizer's pattern; each piece is merged over a segment tree of the ranks of its
adjacent pairs: the root holds the leftmost pair of lowest rank, a merge updates two leaves in logarithmic time, and
merging ends when the root is empty. A worker keeps the ids of the pieces it has met, so that the tree is built once
for each distinct piece (the store is emptied when it grows past a bound; results do not depend on it).

Defined results: null and empty texts give an empty list; strings of special tokens in a text are ordinary text; texts
of any length are encoded whole; repeated rows give repeated results; extra columns are kept by ``with_ids``.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDER = "/opt/tokenizers"
NAME = "byte_bpe_50k"
#: Fixed value: the pattern that cuts a text into pieces, as published with the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
STORE = 400_000
_NONE = 1 << 62


class Encoder:
    """Pieces to ids by merges of lowest rank first."""

    def __init__(self, path: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.cut = regex.compile(PATTERN).findall
        self.store: dict[str, list[int]] = {}

    def piece(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        size = 1
        while size < n:
            size *= 2
        # a leaf holds rank * n + position, so that the least leaf is the leftmost pair of lowest rank
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                tree[size + i] = rank * n + i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

        def put(leaf: int, value: int) -> None:
            i = size + leaf
            tree[i] = value
            i //= 2
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                least = a if a < b else b
                if tree[i] == least:
                    break
                tree[i] = least
                i //= 2

        while (least := tree[1]) != _NONE:
            i = least % n
            j = after[i]
            k = after[j]
            merged = parts[i] + parts[j]
            parts[i], parts[j], after[i] = merged, None, k
            put(j, _NONE)
            rank = None
            if k < n:
                before[k] = i
                rank = ranks.get(merged + parts[k])
            put(i, _NONE if rank is None else rank * n + i)
            h = before[i]
            if h >= 0:
                rank = ranks.get(parts[h] + merged)
                put(h, _NONE if rank is None else rank * n + h)
        return [ranks[p] for p in parts if p is not None]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        store = self.store
        for piece in self.cut(text):
            ids = store.get(piece)
            if ids is None:
                if len(store) > STORE:
                    store.clear()
                ids = self.piece(piece.encode("utf-8", "surrogatepass"))
                if len(piece) < 64:
                    store[piece] = ids
            out += ids
        return out


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def path(name: str = NAME, folder: str = FOLDER) -> str:
    """The rank file of a tokenizer; the vocabulary stays where it is."""
    return f"{folder}/{name}.tiktoken"


def with_ids(df: DataFrame, text: str = "text", ids: str = "ids", file: str | None = None, keep: list[str] | None = None, count: bool = False) -> DataFrame:
    """``df`` with the ids of a text column (or with their number, if ``count``), in Arrow batches without pandas."""
    file = file or path()
    keep = [c for c in df.columns if c not in (text, ids)] if keep is None else keep
    schema = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep], f"`{ids}` " + ("bigint" if count else "array<int>")])
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(file).encode
        for b in batches:
            done = [encode(t) for t in b.column(width).to_pylist()]
            last = pa.array([len(x) for x in done], pa.int64()) if count else pa.array(done, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(width)], last], names=[*keep, ids])

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("_text")).mapInArrow(run, schema)
