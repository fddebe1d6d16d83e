"""The cosines of text.hashed_vector() between neighbouring sentences, in Arrow batches.

As Column functions each sentence costs some hundred interpreted steps a place and pair. Here the words of a batch are counted at once, and its vectors meet place by
place, in the order in which text.dot() adds, so that the numbers are those of text.cosine() to the last bit.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

PLACES = 64
#: Words of which a worker remembers the place, and sentences that are worked on at a time.
KEPT, AT_ONCE = 500_000, 20_000
_known: dict[bytes, int] = {}


def _place(word: bytes) -> int:
    if word not in _known:
        if len(_known) >= KEPT:
            _known.clear()
        _known[word] = int(hashlib.md5(word).hexdigest()[:7], 16) % PLACES
    return _known[word]


def vectors(texts: list[str]) -> np.ndarray:
    """hashed_vector() of each text, a column each."""
    places, sizes = [], []
    for t in texts:
        own = t.lower().encode().split()  # at ASCII white space, as text.words()
        places += map(_place, own)
        sizes.append(len(own))
    at = np.array(places, np.int64) * len(texts) + np.repeat(np.arange(len(texts)), sizes)
    counts = np.bincount(at, minlength=PLACES * len(texts)).reshape(PLACES, len(texts)).astype(np.float64)
    norms = np.sqrt((counts * counts).sum(axis=0))  # whole numbers, so exact in any order
    return counts / np.where(norms > 0, norms, 1.0)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(a.shape[1])
    for x, y in zip(a, b, strict=True):
        out += x * y
    return out


def cosines(v: np.ndarray, apart: int) -> np.ndarray:
    """cosine() of each vector and the one so many places after it."""
    norms = np.sqrt(_dot(v, v))
    n = max(0, v.shape[1] - apart)
    return _dot(v[:, :n], v[:, apart:]) / (norms[:n] * norms[apart:] + 1e-9)


def _blocks(lists: list[list[str]]) -> Iterator[list[list[str]]]:
    some, n = [], 0
    for x in lists:
        if some and n + len(x) > AT_ONCE:
            yield some
            some, n = [], 0
        some.append(x)
        n += len(x)
    if some:
        yield some


def alike(lists: list[list[str]]) -> Iterator[list[float | None]]:
    """Of each list of sentences the cosine of each with the one before it; of the first, null."""
    for some in _blocks(lists):
        found, lo = [None, *cosines(vectors([s for x in some for s in x]), 1).tolist()], 0
        for x in some:
            yield [None, *found[lo + 1 : lo + len(x)]] if x else []
            lo += len(x)


def drops(lists: list[list[str]], window: int = 3, drop: float = 0.8) -> Iterator[list[int]]:
    """segment.boundaries() of each list of sentences."""
    for some in _blocks(lists):
        v = vectors([s for x in some for s in x])
        near, lo = [cosines(v, k).tolist() for k in range(1, window + 1)], 0
        for x in some:
            yield _places([c[lo : lo + max(0, len(x) - k)] for k, c in enumerate(near, 1)], len(x), drop)
            lo += len(x)


def _total(x: list[float]) -> float:
    """In order, without compensation, which sum() of Python has."""
    out = 0.0
    for y in x:
        out += y
    return out


def _places(near: list[list[float]], n: int, drop: float) -> list[int]:
    """near[k - 1][i] is the cosine of sentences i and i + k."""
    if n <= 1:
        return []
    window = range(1, len(near) + 1)
    cohesion = []
    for i in range(n):
        own = [near[k - 1][i - k] for k in reversed(window) if i >= k] + [near[k - 1][i] for k in window if i + k < n]
        cohesion.append(_total(own) / len(own))
    deltas = [b - a for a, b in zip(cohesion, cohesion[1:], strict=False)]
    mean = _total(deltas) / len(deltas)
    sigma = math.sqrt(_total([(x - mean) * (x - mean) for x in deltas]) / len(deltas)) + 1e-9
    kept: list[int] = []
    for i, x in enumerate(deltas, 1):
        if (x - mean) / sigma < -abs(drop) and i - (kept[-1] if kept else 0) >= 3:
            kept.append(i)
    return kept


def added(rows: DataFrame, name: str, of: Callable[[list[list[str]]], Iterator[list]], kind: str, nested: bool = False, sentences: str = "sentences") -> DataFrame:
    """rows with a column of what `of` makes of each array of sentences, or, nested, of each of an array of them, in their place. Null gives null."""
    kept = rows.drop(sentences)
    names = kept.columns
    one = ArrayType({"int": IntegerType(), "double": DoubleType()}[kind])
    field = StructField(name, ArrayType(one) if nested else one)
    element = {"int": pa.int32(), "double": pa.float64()}[kind]
    made = pa.list_(pa.list_(element)) if nested else pa.list_(element)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 500):
                batch = big.slice(lo, 500)
                lists = batch.column(sentences).to_pylist()
                found = iter(of([x or [] for row in lists for x in (row or [])] if nested else [row or [] for row in lists]))
                new = [None if row is None else [next(found) for _ in row] for row in lists] if nested else [None if row is None else x for row, x in zip(lists, found, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(new, made)], [*names, name])

    return rows.mapInArrow(run, StructType([*kept.schema.fields, field]))
