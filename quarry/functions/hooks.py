"""Hooks for tokenizers and models that live in Python workers: loaded once a worker, fed in batches."""

from __future__ import annotations

import os
import threading
from collections.abc import Callable, Iterator, Sequence
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import text as T

#: load() gives a function from texts to the (start, end) character offsets of their tokens.
Offsets = Callable[[Sequence[str]], list[list[tuple[int, int]]]]
#: From a text to array<struct<start, end>>, the character offsets of its tokens.
Tokenizer = Callable[[Column], Column]
SPANS = "array<struct<start:int,end:int>>"
#: So many characters of texts, or one longer text, are with a tokenizer at a time.
AT_ONCE = 1 << 18
_loaded: dict[str, Any] = {}


def once(name: str, load: Callable[[], Any]) -> Any:
    """What load() gives, the first time in this process; a worker serves many tasks and keeps it."""
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def pieces_of_four(text: Column) -> Column:
    """The built-in tokenizer: pieces of four characters."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(4))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.least(i + 4, F.length(text)).alias("end")))


def tokenizer(name: str, load: Callable[[], Offsets], batch: int = 64) -> Tokenizer:
    """A tokenizer of Python: a column of offsets, made in Arrow batches, `batch` texts at a time and no more than AT_ONCE characters of them. Null texts have
    no tokens. Offsets are kept as pairs of 32-bit integers, eight bytes a token of the batch."""

    @F.arrow_udf(SPANS)
    def spans(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = once(name, load)
        for column in columns:
            ends, flat = [0], [np.empty(0, np.int32)]
            for texts in _some(column, batch):
                found = encode(texts)
                flat.append(np.fromiter(chain.from_iterable(chain.from_iterable(found)), np.int32, 2 * sum(map(len, found))))
                for some in found:
                    ends.append(ends[-1] + len(some))
            both = np.concatenate(flat)
            pairs = pa.StructArray.from_arrays([pa.array(both[0::2]), pa.array(both[1::2])], ["start", "end"])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)

    return lambda text: spans(text)


def _some(column: pa.Array, batch: int) -> Iterator[list[str]]:
    """The texts of a column, null ones empty, `batch` at a time; fewer where they have more than AT_ONCE characters."""
    some, size = [], 0
    for i in range(len(column)):
        text = column[i].as_py() or ""
        if some and (len(some) == batch or size + len(text) > AT_ONCE):
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


def file_tokenizer(path: str) -> Tokenizer:
    """A tokenizer of the tokenizers library from its JSON file, which every worker must be able to open. Special tokens are ordinary text."""

    def load() -> Offsets:
        # a task has one core; the library's own threads would only wait for each other, each with memory of its own
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer as Library

        own = Library.from_file(path)
        own.encode_special_tokens = True
        return lambda texts: [e.offsets for e in own.encode_batch(list(texts), add_special_tokens=False)]

    return tokenizer(f"file:{path}", load)


def count_tokens(text: Column, by: Tokenizer | None = None) -> Column:
    """By a tokenizer, at least 0; without one the estimate of four characters a token, at least 1."""
    return T.approx_tokens(text) if by is None else F.size(by(text))


def scored_pairs(name: str, load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], batch: int = 8, seconds: float | None = None) -> Callable[[Column, Column], Column]:
    """A column struct<score, error> of a model that scores lists of (query, text).

    The model is loaded once a worker and sees `batch` pairs at a time, across rows. A batch that fails, or takes longer
    than `seconds`, gives null scores with what went wrong, and the rows after it go on.
    """

    def asked(model: Callable, rows: list[tuple[str, str]]) -> list[tuple[float | None, str | None]]:
        out: list = []

        def work() -> None:
            try:
                out.append([(float(s), None) for s in model(rows)])
            except Exception as e:  # noqa: BLE001  a model may fail in any way, and the row says how
                out.append([(None, f"{type(e).__name__}: {e}")] * len(rows))

        if seconds is None:
            work()
        else:
            thread = threading.Thread(target=work, daemon=True)
            thread.start()
            thread.join(seconds)
        found = out[0] if out else [(None, f"no answer in {seconds} s")] * len(rows)
        return found if len(found) == len(rows) else [(None, f"{len(found)} scores for {len(rows)} pairs")] * len(rows)

    @F.arrow_udf("struct<score:double,error:string>")
    def scored(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = once(name, load)
        for queries, texts in columns:
            rows = list(zip(queries.to_pylist(), texts.to_pylist(), strict=True))
            found = [x for lo in range(0, len(rows), batch) for x in asked(model, rows[lo : lo + batch])]
            yield pa.StructArray.from_arrays([pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], pa.string())], ["score", "error"])

    return lambda query, text: scored(query, text)
