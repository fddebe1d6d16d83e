"""Byte-level BPE encoding and decoding (operator 1).

The merges come from a file of ranks. Each match of the split pattern is encoded by itself with
the tokenizers library: its bytes are mapped to the printable characters of byte-level BPE and
the merges of those ranks are applied. Texts travel as Arrow batches. With the pattern BLANK_LED a
single blank or line feed between two characters that are no white space always begins a match, so texts without
other white space are cut there first; what a task has seen between such cuts is looked up, the rest of a
batch is encoded in one call.
Decoding looks up the bytes of each id: the byte-character table, already reversed for every token.

Edge cases: a null text encodes like an empty one (no ids); any other text round-trips exactly,
of any length; ids that are null or not in the file decode to no bytes; rows may repeat; empty tables give empty results; other columns stay as they are
and one with the name of a result is replaced.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Pieces, words and sizes of words kept by a task. Longer ones than PIECE characters are not kept, so that the memory is bounded.
KEPT, KEPT_SIZES, PIECE = 300_000, 1_500_000, 64
#: Marks between pieces and after words in what the tokenizer sees; no byte is spelled so.
BETWEEN, AFTER = "\ue000", "\ue001"
#: Fixed value: a public pattern in which a blank stands only at the beginning of a match or among white space.
BLANK_LED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space other than single blanks and line feeds: what ASCII texts may have, and the rest of it.
_ODD = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f")
_ODDER = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def odd(text: str) -> bool:
    """Whether a text has white space other than single blanks and line feeds between characters that are none."""
    return any(x in text for x in _ODD) or (not text.isascii() and _ODDER.search(text) is not None)


def byte_characters() -> list[str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else from 256 upwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in set(plain) else next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Codec:
    """Encodes and decodes by one file of ranks; made once in each Python worker."""

    made: dict[tuple[str, str], Codec] = {}

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        # a task has one core; the library's own threads would only wait for each other
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        ranks = read_ranks(path)
        names = byte_characters()
        spelled = {token: "".join(names[b] for b in token) for token in ranks}
        # every split of a token in two known parts is a merge, in order of the token's rank
        merges = [
            (spelled[a], spelled[b])
            for token, _ in sorted(ranks.items(), key=lambda x: x[1])
            for a, b in sorted(
                ((token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks),
                key=lambda x: (ranks[x[0]], ranks[x[1]]),
            )
        ]
        self.after = max(ranks.values()) + 1
        vocabulary = {spelled[t]: i for t, i in ranks.items()} | {AFTER: self.after}
        self.model = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True, cache_capacity=0))
        self.model.pre_tokenizer = pre_tokenizers.Split(BETWEEN, "removed")
        self.pattern = regex.compile(pattern)
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.table[i] = token
        self.lengths = np.array([len(t) for t in self.table], np.int64)
        self.table.append(b"")  # of ids that are none
        self.latin = dict(enumerate(names))
        self.marked = self.latin | {ord("\t"): BETWEEN, ord("\n"): AFTER}
        self.cut = pattern == BLANK_LED
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.sizes: dict[str, int] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        if (path, pattern) not in cls.made:
            cls.made[path, pattern] = cls(path, pattern)
        return cls.made[path, pattern]

    def _spelled(self, piece: str) -> str:
        return piece.encode().decode("latin-1").translate(self.latin)

    def _known(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of each piece."""
        if len(self.pieces) > KEPT:
            self.pieces = {}
        known = self.pieces
        new = list(pieces - known.keys())
        found = {}
        if new:
            encoded = self.model.encode_batch_fast([self._spelled(p) for p in new], add_special_tokens=False)
            found = {p: np.array(e.ids, "<i4").tobytes() for p, e in zip(new, encoded, strict=True)}
            known.update((p, x) for p, x in found.items() if len(p) <= PIECE)
        return {p: known.get(p) or found[p] for p in pieces}

    def _joined(self, texts: list[str]) -> list[bytes]:
        found = [self.pattern.findall(t) for t in texts]
        ids = self._known(set().union(*found))
        return [b"".join([ids[p] for p in some]) for some in found]

    def _learn(self, words: set[str], known: dict, of: Callable) -> list[str]:
        """Adds what `of` makes of the ids of each word that known lacks (a blank goes before a word that does not begin with
        a line feed), and returns those words. of: the ids of several words, the first and the last place of each, and what
        comes before them."""
        if len(known) > (KEPT_SIZES if known is self.sizes else KEPT):
            known.clear()
        new = list(words - known.keys())
        ends = {w for w in ("", "\n") if w in words and w not in known}
        for w, raw in zip(ends, self._joined([w or " " for w in ends]), strict=True):
            known[w] = of(np.frombuffer(raw, "<i4"), [0], [len(raw) // 4], [0])[0]
        rest = [w for w in new if w not in ends] if ends else new
        # line feeds between the words are pieces of their own, and there are no tabs: both can stand for the marks
        for lo in range(0, len(rest), 4000):
            some = rest[lo : lo + 4000]
            fed = [w[0] == "\n" for w in some]
            pieces = self.pattern.findall("\n".join([w[1:] if f else " " + w for w, f in zip(some, fed, strict=True)]) + "\n")
            spelled = "\t".join(pieces).encode().decode("latin-1").translate(self.marked)
            ids = np.array(self.model.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, "<i4")
            last = np.flatnonzero(ids == self.after)
            known.update(zip(some, of(ids, np.concatenate(([0], last[:-1] + 1)), last, fed), strict=True))
        return new

    def _ids(self, ids: np.ndarray, first: np.ndarray, last: np.ndarray, fed: list[bool]) -> list[bytes]:
        raw, feed = ids.tobytes(), self._joined(["\n"])[0]
        return [feed + raw[4 * a : 4 * b] if f else raw[4 * a : 4 * b] for a, b, f in zip(first, last, fed, strict=True)]

    def _sizes(self, ids: np.ndarray, first: np.ndarray, last: np.ndarray, fed: list[bool]) -> list[int]:
        return (np.subtract(last, first) + np.array(fed, np.int64) * (len(self._joined(["\n"])[0]) // 4)).tolist()

    def _blocks(self, texts: list[str]) -> Iterator[tuple[list[str], list[list[str] | None]]]:
        """About four megabytes of texts at a time, and the words of those that are cut."""
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size < 4 << 20):
                size += len(texts[hi])
                hi += 1
            some, lo = texts[lo:hi], hi
            yield some, [t.replace("\n", " \n").split(" ") if self.cut and not odd(t) else None for t in some]

    def _each(self, texts: list[str], known: dict, of: Callable, whole: Callable, part: Callable) -> Iterator:
        """whole(ids) of a text that is not cut, part(ids of its first word, its other words) of one that is."""
        for some, cut in self._blocks(texts):
            first = iter(self._joined([t if c is None else c.pop(0) for t, c in zip(some, cut, strict=True)]))
            new = self._learn(set().union(*[c for c in cut if c]), known, of)
            for c, ids in zip(cut, first, strict=True):
                yield whole(ids) if c is None else part(ids, c)
            for w in new:
                if len(w) > PIECE:
                    del known[w]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        as_ids = lambda raw: np.frombuffer(raw, "<i4")
        return self._each(texts, self.words, self._ids, as_ids, lambda first, rest: as_ids(b"".join([first, *map(self.words.__getitem__, rest)])))

    def count(self, texts: list[str]) -> list[int]:
        """The number of ids of each text."""
        return [*self._each(texts, self.sizes, self._sizes, lambda raw: len(raw) // 4, lambda first, rest: len(first) // 4 + sum(map(self.sizes.__getitem__, rest)))]

    def bytes_of(self, ids: list[int]) -> bytes:
        table = self.table
        return b"".join([table[i] for i in ids])

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each token in characters of the text. A token that begins or ends inside
        a character counts that character as its own."""
        data = np.frombuffer(text.encode(), np.uint8)
        before = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        ends = np.cumsum(self.lengths[ids])
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)[: len(ends)]
        # the character that holds byte i has number before[i + 1] - 1
        return before[np.minimum(starts + 1, len(data))] - 1, before[ends]


def _added(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in new}
    return pa.RecordBatch.from_pydict(kept | new)


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(v) for v in values]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.empty(0, np.int32), pa.int32()))


def _schema(df: DataFrame, *fields: T.StructField) -> T.StructType:
    new = {f.name for f in fields}
    return T.StructType([f for f in df.schema.fields if f.name not in new] + list(fields))


def encode(df: DataFrame, ranks: str, pattern: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """Adds `ids` (array<int>), and with offsets also `starts` and `ends` in characters of the text."""
    ints = T.ArrayType(T.IntegerType(), True)
    fields = [T.StructField(n, ints) for n in (["ids", "starts", "ends"] if offsets else ["ids"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks, pattern)
        for big in batches:
            for lo in range(0, big.num_rows, 200):
                batch = big.slice(lo, 200)
                texts = [t or "" for t in batch.column(text).to_pylist()]
                ids = list(codec.encode(texts))
                new = {"ids": _lists(ids)}
                if offsets:
                    spans = [codec.offsets(t, i) for t, i in zip(texts, ids, strict=True)]
                    new |= {n: _lists([s[k].astype(np.int32) for s in spans]) for k, n in enumerate(("starts", "ends"))}
                yield _added(batch, new)

    return df.mapInArrow(run, _schema(df, *fields))


def count(df: DataFrame, ranks: str, pattern: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """Has `name`, the number of ids of the text, in place of the text."""
    kept = [f for f in df.schema.fields if f.name not in (text, name)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks, pattern)
        for big in batches:
            for lo in range(0, big.num_rows, 1000):
                batch = big.slice(lo, 1000)
                n = codec.count([t or "" for t in batch.column(text).to_pylist()])
                yield pa.RecordBatch.from_pydict({f.name: batch.column(f.name) for f in kept} | {name: pa.array(n, pa.int64())})

    return df.mapInArrow(run, T.StructType([*kept, T.StructField(name, T.LongType())]))


def decode(df: DataFrame, ranks: str, pattern: str, ids: str = "ids", as_text: bool = True) -> DataFrame:
    """Adds `decoded` (binary: the exact bytes) and, if asked, `decoded_text`.

    Ids may end or begin inside a character: bytes that are no UTF-8 stay exact in `decoded` and
    become U+FFFD in `decoded_text`. Null ids decode to nothing.
    """
    fields = [T.StructField("decoded", T.BinaryType())] + [T.StructField("decoded_text", T.StringType())] * as_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks, pattern)
        for big in batches:
            for lo in range(0, big.num_rows, 200):
                batch = big.slice(lo, 200)
                column = batch.column(ids)
                ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)))).tolist()
                flat = pc.fill_null(column.flatten(), -1).to_numpy(zero_copy_only=False)
                none = len(codec.table) - 1
                flat = np.where((flat < 0) | (flat > none), none, flat).tolist()
                data = [codec.bytes_of(flat[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
                new = {"decoded": pa.array(data, pa.binary())}
                if as_text:
                    new["decoded_text"] = pa.array([d.decode("utf-8", "replace") for d in data], pa.string())
                yield _added(batch, new)

    return df.mapInArrow(run, _schema(df, *fields))


def digest(df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """n_tokens, ids_sha256 (of decimal ids joined by commas) and decoded_sha256 (of the bytes)."""
    from pyspark.sql import functions as F

    return df.withColumns(
        {
            "n_tokens": F.size(ids).cast("long"),
            "ids_sha256": F.sha2(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"), 256),
            "decoded_sha256": F.sha2(decoded, 256),
        }
    )

