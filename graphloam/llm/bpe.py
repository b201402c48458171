"""Byte-pair encoding of a whole corpus with a public vocabulary.

Each pre-token is encoded by a segment tree over the ranks of its adjacent
pairs.  A leaf holds rank and position of one pair, so the root holds the
leftmost pair of lowest rank; a merge changes three leaves, each with a
logarithmic update.  Long runs without a break take n log n, whatever they hold.
"""

from __future__ import annotations

import array
import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

VOCABULARY = "byte_bpe_50k.tiktoken"
CACHED_WORDS = 200_000  # of a worker; a full cache starts anew, which changes no result
CACHED_BYTES = 64
BATCH_IDS = 1 << 20
_NEVER = 1 << 62
_PLACE = (1 << 32) - 1


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class BytePairEncoder:
    """Encoder for a vocabulary of ranks (``base64 rank`` a line)."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        # merged rank of each pair of tokens that together are a token
        self.pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank
        self.bytes = [self.ranks[bytes([b])] for b in range(256)]
        self.pattern = regex.compile(pattern)
        self.cache: dict[str, tuple[int, ...]] = {}

    def word(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        n, pairs = len(data), self.pairs
        token = [self.bytes[b] for b in data]
        width = 1 << (n - 1).bit_length()
        tree = [_NEVER] * (2 * width)
        for i in range(n - 1):
            if (rank := pairs.get(token[i] << 32 | token[i + 1])) is not None:
                tree[width + i] = rank << 32 | i
        for node in range(width - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, key: int) -> None:
            node = width + i
            tree[node] = key
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                low = a if a < b else b
                if tree[node] == low:
                    return
                tree[node] = low
                node >>= 1

        while (lowest := tree[1]) < _NEVER:
            i = lowest & _PLACE
            j = after[i]
            k, h = after[j], before[i]
            token[i] = merged = lowest >> 32
            after[i] = k
            put(j, _NEVER)
            rank = None
            if k < n:
                before[k] = i
                rank = pairs.get(merged << 32 | token[k])
            put(i, _NEVER if rank is None else rank << 32 | i)
            if h >= 0:
                rank = pairs.get(token[h] << 32 | merged)
                put(h, _NEVER if rank is None else rank << 32 | h)
        out, i = [], 0
        while i < n:
            out.append(token[i])
            i = after[i]
        return out

    def encode(self, text: str | None, into: array.array) -> None:
        """Append the ids of *text*; strings of special tokens are plain text."""
        if not text:
            return
        cache = self.cache
        words = self.pattern.findall(text) if len(text) < 1 << 20 else (m.group() for m in self.pattern.finditer(text))
        for w in words:
            ids = cache.get(w)
            if ids is None:
                data = w.encode("utf-8")
                ids = self.word(data)
                if len(data) <= CACHED_BYTES:
                    if len(cache) >= CACHED_WORDS:
                        cache.clear()
                    cache[w] = tuple(ids)
            into.extend(ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> BytePairEncoder:
    import public_tokenizers

    return BytePairEncoder(path, public_tokenizers.PATTERN)


def encode(docs: DataFrame, text: str = "text", *, path: str | None = None, ids: str = "ids") -> DataFrame:
    """*docs* with a column of the ids of *text* in place of it.

    Null and empty texts get an empty list.  Every text is encoded whole; other
    columns pass unchanged, but for one named as *ids*, which the result
    replaces.  Rows, repeated ones too, come out as often as they came in.
    """
    path = path or vocabulary_path()
    kept = [c for c in docs.columns if c not in (text, ids)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            at = 0
            while at < batch.num_rows:
                flat, ends, first = array.array("i"), [0], at
                while at < batch.num_rows and len(flat) < BATCH_IDS:
                    coder.encode(texts[at].as_py(), flat)
                    ends.append(len(flat))
                    at += 1
                values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, dtype="int32") if flat else np.array([], "int32")))
                part = batch.slice(first, at - first)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], values], names=[*kept, ids])

    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`")).mapInArrow(run, schema)


def count_tokens(docs: DataFrame, text: str = "text", *, path: str | None = None, name: str = "n_tokens") -> DataFrame:
    """*docs* with the number of tokens of *text* in place of it (0 for null)."""
    path = path or vocabulary_path()
    kept = [c for c in docs.columns if c not in (text, name)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            counts = []
            for t in batch.column(batch.num_columns - 1):
                flat = array.array("i")
                coder.encode(t.as_py(), flat)
                counts.append(len(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*kept, name])

    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(name, T.LongType())])
    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`")).mapInArrow(run, schema)
