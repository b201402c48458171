"""Repetition inside a single document.

The share of a text's words that lie in a run which occurred earlier in the
same text.  Runs of a fixed length get exact names by doubling: two runs have
one name just if they are equal, since a run's name is the pair of the names
of its halves.  A batch of documents is named at once.

This stands in the place of cross-document line frequency, the method dealt
for problem 8, which is not built: a line held by many documents tells nothing
of how far one document repeats itself.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

RUN_WORDS = 5
RUN_CHARS = 10
BATCH_UNITS = 1 << 19

_WORD = re.compile(r"[^\W_]+")
_HAN = re.compile("[㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]")


def units(text: str | None) -> tuple[list[str], bool]:
    """The words of a text, or its characters if it is Chinese (more Han
    characters than words of other scripts), without case, spacing and
    punctuation."""
    if not text:
        return [], False
    plain = unicodedata.normalize("NFC", text).casefold()
    words = _WORD.findall(plain)
    han = len(_HAN.findall(plain))
    if han and han > sum(1 for w in words if not _HAN.search(w)):
        return [c for w in words for c in w], True
    return words, False


def _named(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of pairs."""
    return np.unique(a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def _runs(ids: np.ndarray, length: int) -> np.ndarray:
    """Names of the runs of *length* from each place, by binary doubling."""
    name, have, power, size = None, 0, ids, 1
    while True:
        if length & size:
            if name is None:
                name, have = power, size
            else:
                n = len(ids) - have - size + 1
                name, have = _named(name[:n], power[have : have + n]), have + size
        if have == length:
            return name
        n = len(ids) - 2 * size + 1
        power, size = _named(power[:n], power[size : size + n]), 2 * size


def repeated(docs: list[list[str]], length: int) -> np.ndarray:
    """Of each document, how many units lie in a run seen earlier in it."""
    size = np.array([len(d) for d in docs], int)
    total = int(size.sum())
    if total < length:
        return np.zeros(len(docs), int)
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for d in docs for w in d), np.int64, total)
    doc = np.repeat(np.arange(len(docs)), size)
    names = _runs(ids, length)
    starts = np.flatnonzero(doc[: len(names)] == doc[length - 1 :])
    _, first, which = np.unique(names[starts] * len(docs) + doc[starts], return_index=True, return_inverse=True)
    again = starts[first[which] < np.arange(len(starts))]
    edge = np.zeros(total + 1, int)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + length, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=len(docs))


def measure(docs: DataFrame, text: str = "text", *, run_words: int = RUN_WORDS, run_chars: int = RUN_CHARS) -> DataFrame:
    """*docs* with, in place of *text*, ``n_units`` (words, or characters of a
    Chinese text), ``n_repeated`` and ``share`` (0 for a text without units, null
    texts too).  Whole texts, of any length, are measured; each row by itself,
    so repeated rows get equal shares.  Other columns pass unchanged but for
    those of these three names, which the result replaces.
    """
    new = ["n_units", "n_repeated", "share"]
    kept = [c for c in docs.columns if c not in (text, *new)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            at = 0
            while at < batch.num_rows:
                first, held, part = at, 0, []
                while at < batch.num_rows and held < BATCH_UNITS:
                    part.append(units(texts[at].as_py()))
                    held += len(part[-1][0])
                    at += 1
                n = np.array([len(u) for u, _ in part], np.int64)
                got = np.zeros(len(part), np.int64)
                for chinese, length in ((False, run_words), (True, run_chars)):
                    which = [i for i, (_, c) in enumerate(part) if c == chinese]
                    if which:
                        got[which] = repeated([part[i][0] for i in which], length)
                share = np.divide(got, n, out=np.zeros(len(part)), where=n > 0)
                yield pa.RecordBatch.from_arrays([*batch.slice(first, at - first).columns[:-1], pa.array(n), pa.array(got), pa.array(share)], names=[*kept, *new])

    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("n_units", T.LongType()), T.StructField("n_repeated", T.LongType()), T.StructField("share", T.DoubleType())])
    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`")).mapInArrow(run, schema)
