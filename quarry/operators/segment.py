"""Chunkers by meaning, by separators and by sections, as arrays within one row: nothing is shuffled.

An embedder is a function from a text Column to an array<double> Column; the built-in one hashes words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import hashed
from quarry.functions import text as T
from quarry.operators import pack

Embedder = Callable[[Column], Column]
SEPARATORS = ("\n\n", "\n", " ", "")
INTS = "array<int>"


def _pieces(items: Column, cuts: Column) -> Column:
    """Slices of an array that begin at the ascending cuts, the first being 0."""
    return F.transform(cuts, lambda c, k: F.slice(items, c + 1, F.coalesce(F.get(cuts, k + 1), F.size(items)) - c))


def semantic(text: Column, target: int = 700, least: int = 120, threshold: float = 0.65, embed: Embedder = T.hashed_vector, alike: Column | None = None) -> Column:
    """array<struct<chunk, sentence_count>>: runs of sentences, cut where the cosine of neighbours is below
    the threshold or a run would exceed the target. Runs of fewer than `least` tokens are left out; a
    text of one sentence is one chunk whatever its size. alike has the cosine of each sentence with the one before it, where they are known."""

    def cut(known: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            here = F.get(known, i)
            near = T.cosine(F.get(known, i - 1)["v"], here["v"]) if alike is None else F.get(alike, i)
            apart = (i > 0) & ((near < threshold) | (a["n"] + here["n"] > target))
            return F.struct(F.when(apart, F.array_append(a["cuts"], i)).otherwise(a["cuts"]).alias("cuts"), F.when(apart, here["n"]).otherwise(a["n"] + here["n"]).alias("n"))

        start = F.struct(F.array(F.lit(0)).alias("cuts"), F.lit(0).alias("n"))
        return F.aggregate(F.sequence(F.lit(0), F.size(known) - 1), start, step, lambda a: a["cuts"])

    def chunks(found: Column) -> Column:
        known = F.transform(found, lambda s: F.struct(s.alias("s"), T.approx_tokens(s).alias("n"), *([embed(s).alias("v")] if alike is None else [])))
        runs = T.bound(known, lambda k: T.bound(cut(k), lambda c: _pieces(k, c)))
        rows = F.transform(runs, lambda r: F.struct(F.array_join(F.transform(r, lambda x: x["s"]), " ").alias("chunk"), F.size(r).alias("sentence_count")))
        return F.filter(rows, lambda r: T.approx_tokens(r["chunk"]) >= least)

    whole = F.array(F.struct(text.alias("chunk"), F.lit(1).alias("sentence_count")))
    return F.when(text.isNotNull(), T.bound(T.sentences(text), lambda s: F.when(F.size(s) <= 1, whole).otherwise(chunks(s))))


def by_semantic(docs: DataFrame, keys: list[str], text: str = "text", embed: Embedder = T.hashed_vector, **options) -> DataFrame:
    known = docs.select(*keys, F.col(text).alias("of"))
    if embed is T.hashed_vector:
        known = hashed.added(known.withColumn("sentences", T.sentences(F.col("of"))), "near", hashed.alike, "double")
    chunks = semantic(F.col("of"), embed=embed, alike=F.col("near") if embed is T.hashed_vector else None, **options)
    found = known.select(*keys, F.posexplode(chunks).alias("chunk_no", "s"))
    return found.select(*keys, "chunk_no", "s.chunk", "s.sentence_count")


def hybrid(text: Column, target: int = 700, least: int = 120, threshold: float = 0.65, embed: Embedder | None = T.hashed_vector, parts: Column | None = None, alike: Column | None = None) -> Column:
    """array<struct<chunk, section_path>>: markdown sections; those over 1.5 targets are cut by meaning (by
    sentences without an embedder); then near copies of a chunk kept before go. parts are the sections of the text and alike the cosines of
    the sentences of each, where they are known."""
    row = lambda c, s: F.struct(c.alias("chunk"), s["section_path"].alias("section_path"))

    def finer(s: Column, near: Column | None = None) -> Column:
        if embed is None:
            return F.transform(pack.packed(T.sentences(s["chunk"]), target, least, 2), lambda c: row(c, s))
        return F.transform(semantic(s["chunk"], target, least, threshold, embed, near), lambda c: row(c["chunk"], s))

    split = lambda s, near=None: F.when(T.approx_tokens(s["chunk"]) > 1.5 * target, finer(s, near)).otherwise(F.array(row(s["chunk"], s)))
    parts = pack.sections(text) if parts is None else parts
    return pack.first_of_alike(F.flatten(F.transform(parts, lambda s: split(s)) if alike is None else F.zip_with(parts, alike, split)))


def by_hybrid(docs: DataFrame, keys: list[str], text: str = "text", target: int = 700, embed: Embedder | None = T.hashed_vector, **options) -> DataFrame:
    known = docs.select(*keys, pack.sections(F.col(text)).alias("parts"))
    if embed is T.hashed_vector:
        long = F.transform("parts", lambda s: F.when(T.approx_tokens(s["chunk"]) > 1.5 * target, T.sentences(s["chunk"])).otherwise(F.array().cast("array<string>")))
        known = hashed.added(known.withColumn("sentences", long), "near", hashed.alike, "double", nested=True)
    chunks = hybrid(F.lit(None), target, embed=embed, parts=F.col("parts"), alike=F.col("near") if embed is T.hashed_vector else None, **options)
    found = known.select(*keys, F.posexplode(chunks).alias("chunk_no", "s"))
    return found.select(*keys, "chunk_no", "s.chunk", "s.section_path")


def cascade(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters where separators allow: cut at the first separator that occurs, the
    longer pieces at the next one, neighbours merged again with an overlap. Separators open their piece."""
    here = next((s for s in separators if not s or s in text), "")
    rest = separators[separators.index(here) + 1 :] if here in separators else ()
    if here:
        head, *more = text.split(here)
        parts = [p for p in [head, *(here + m for m in more)] if p]
    else:
        parts = list(text)
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        window: list[str] = []
        total = 0
        for p in run:
            if total + len(p) > size and window:
                out.append("".join(window).strip())
                while window and (total > overlap or total + len(p) > size):
                    total -= len(window.pop(0))
            window.append(p)
            total += len(p)
        out.append("".join(window).strip())
        run.clear()

    for p in parts:
        if len(p) < size:
            run.append(p)
            continue
        flush()
        out += cascade(p, size, overlap, rest) if rest else [p]
    flush()
    return [x for x in out if x]


#: Characters of pieces that a task hands on at a time.
HANDED_ON = 1 << 20


def by_recursion(docs: DataFrame, key: str, text: str = "text", size: int = 4000, overlap: int = 400) -> DataFrame:
    """key, chunk_no, char_start, chunk by the cascade of blank lines, line feeds, blanks and characters."""
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the size")
    kind, size_of = docs.schema[key].dataType.simpleString(), size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.string())

            def made(out: list[tuple], kinds: tuple = kinds) -> pa.RecordBatch:
                columns = list(zip(*out, strict=True)) or [()] * 4
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "chunk_no", "char_start", "chunk"])

            out, size = [], 0
            for k, t in zip(batch.column(0), batch.column(1), strict=True):
                text = t.as_py() or ""
                at, before = 0, 0
                for no, piece in enumerate(cascade(text, size_of, overlap)):
                    at = text.find(piece, max(0, at + before - overlap) if no else 0)
                    before = len(piece)
                    out.append((k.as_py(), no, at, piece))
                    size += before
                if size > HANDED_ON:  # pieces overlap, so that a whole batch of them could be much more than its texts
                    yield made(out)
                    out, size = [], 0
            yield made(out)

    return docs.select(key, text).mapInArrow(run, f"key {kind}, chunk_no int, char_start int, chunk string").withColumnRenamed("key", key)


def headed(text: Column, whole: bool = True) -> Column:
    """array<struct<section, body>> by heading lines, which are not in the bodies. The part before the first
    heading is called Document; a heading without a line below it gives none; headings alone give the whole text, or nothing without whole."""
    title = lambda line: T.strip(F.regexp_replace(line, r"^[# ]+|[# ]+\z", ""))

    def sections(lines: Column) -> Column:
        heads = F.filter(F.transform(lines, lambda line, i: F.when(T.is_heading(line), i)), lambda i: i.isNotNull())
        starts = F.concat(F.array(F.lit(-1)), heads)

        def section(s: Column, k: Column, all_: Column) -> Column:
            n = F.coalesce(F.get(all_, k + 1), F.size(lines)) - s - 1
            name = F.when(s < 0, "Document").otherwise(title(F.get(lines, s)))
            return F.struct(name.alias("section"), F.when(n > 0, T.strip(F.array_join(F.slice(lines, s + 2, F.greatest(n, F.lit(0))), "\n"))).alias("body"))

        return T.bound(starts, lambda x: F.filter(F.transform(x, lambda s, k: section(s, k, x)), lambda b: b["body"].isNotNull()))

    found = T.bound(F.split(text, "\n", -1), sections)
    if not whole:
        return found
    alone = F.array(F.struct(F.lit("Document").alias("section"), text.alias("body")))
    return T.bound(found, lambda f: F.when(F.size(f) == 0, alone).otherwise(f))


def by_headings(docs: DataFrame, keys: list[str], text: str = "text", whole: bool = True, crlf: bool = True) -> DataFrame:
    """keys, section_no, section, body: headed() of each text; with crlf, a carriage return and line feed count as a line feed."""
    lines = F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")) if crlf else F.col(text)
    found = docs.select(*keys, F.posexplode(headed(T.normalize_whitespace(lines), whole)).alias("section_no", "s"))
    return found.select(*keys, "section_no", "s.section", "s.body")


# Blocks that sentences do not cut, and the names of their stand-ins.
ATOMIC = {"CODE": r"(?s)```.*?```", "TABLE": r"(?ms)(?:\n\s*\|.*\|[\s\S]*?(?:\n\n|$))"}


def _stashed(text: Column) -> Column:
    """struct<text, blocks>: each code block and table replaced by a numbered stand-in, and what they stand for."""

    def stash(x: Column, name: str) -> Column:
        kept = F.split(x["text"], ATOMIC[name], -1)
        found = F.regexp_extract_all(x["text"], F.lit(ATOMIC[name]), F.lit(0))
        mark = lambda i: F.concat(F.lit(f"__{name}_"), (F.size(x["blocks"]) + i).cast("string"), F.lit("__"))
        marked = lambda k, f: F.array_join(F.transform(k, lambda p, i: F.concat(p, F.when(i < F.size(f), mark(i)).otherwise(""))), "")
        keyed = F.transform(found, lambda b, i: F.struct(mark(i).alias("mark"), b.alias("block")))
        return F.struct(marked(kept, found).alias("text"), F.concat(x["blocks"], keyed).alias("blocks"))

    empty = F.array().cast("array<struct<mark:string,block:string>>")
    first = F.struct(text.alias("text"), empty.alias("blocks"))
    return T.bound(T.bound(first, lambda x: stash(x, "CODE")), lambda x: stash(x, "TABLE"))


def _whole(x: Column) -> Column:
    """The sentences of a stashed text; one that is a stand-in is its block."""
    return F.transform(T.split_sentences(x["text"]), lambda s: F.coalesce(F.get(F.filter(x["blocks"], lambda b: b["mark"] == s), F.lit(0))["block"], s))


def _restored(c: Column, blocks: Column) -> Column:
    return F.aggregate(blocks, c, lambda s, b: F.replace(s, b["mark"], b["block"]))


def boundaries(sentences: Column, embed: Embedder = T.hashed_vector, window: int = 3, drop: float = 0.8) -> Column:
    """Places (from 0) of sentences that begin a segment: where the mean cosine to the neighbours within the window
    drops by more than `drop` deviations, at least three sentences after the last one."""

    def cohesion(v: Column) -> Column:
        n = F.size(v)
        near = lambda i: F.filter(F.sequence(F.greatest(i - window, F.lit(0)), F.least(i + window, n - 1)), lambda j: j != i)
        mean = lambda i: F.aggregate(near(i), F.lit(0.0), lambda s, j: s + T.cosine(F.get(v, i), F.get(v, j))) / F.size(near(i))
        return F.transform(F.sequence(F.lit(0), n - 1), mean)

    def places(s: Column) -> Column:
        deltas = F.transform(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.get(s, i) - F.get(s, i - 1))
        return T.bound(deltas, drops)

    def drops(d: Column) -> Column:
        total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
        mean = total(d) / F.size(d)

        def pruned(m: Column) -> Column:
            sigma = F.sqrt(total(F.transform(d, lambda x: (x - m) * (x - m))) / F.size(d)) + 1e-9
            low = T.bound(sigma, lambda s: F.filter(F.transform(d, lambda x, i: F.when((x - m) / s < -abs(drop), i + 1)), lambda i: i.isNotNull()))
            start = F.array().cast(INTS)
            return F.aggregate(low, start, lambda kept, i: F.when(i - F.coalesce(F.get(kept, F.size(kept) - 1), F.lit(0)) >= 3, F.array_append(kept, i)).otherwise(kept))

        return T.bound(mean, pruned)

    found = T.bound(T.bound(F.transform(sentences, lambda s: embed(s)), cohesion), places)
    return F.when(F.size(sentences) <= 1, F.array().cast(INTS)).otherwise(found)


def by_boundaries(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, places: the boundaries() of the sentences of each text by the built-in embedder."""
    return hashed.added(docs.select(*keys, T.split_sentences(F.col(text)).alias("sentences")), "places", hashed.drops, "int")


WORD = re.compile(r"[^\W_]+")


def tiles(sentences: list[str], width: int = 20, around: int = 10, apart: int = 4) -> list[int]:
    """Places (from 0) of sentences that begin a tile (Hearst 1997).

    Words fall in pieces of `width`. At each gap between pieces the term counts of up to `around` pieces before and behind are compared by
    cosine; both counts slide along, so a text costs as many steps as it has words. Scores are smoothed over neighbours; the depth of a gap is how far
    scores rise on both sides of it; gaps deeper than the mean less half a deviation are boundaries, the deepest first, none
    within `apart` of another. A boundary moves to the nearest start of a sentence.
    """
    words, starts = [], []
    for s in sentences:
        starts.append(len(words))
        words += WORD.findall(s.lower())
    pieces = [words[i : i + width] for i in range(0, len(words), width)]
    gaps = len(pieces) - 1
    if gaps < 2 or len(sentences) < 2:
        return []
    left, right, scores = Counter(), Counter(), []
    dot, square = 0, [0, 0]

    def add(own: Counter, other: Counter, side: int, piece: list[str], by: int) -> None:
        nonlocal dot
        for w in piece:
            dot += by * other[w]
            square[side] += 2 * by * own[w] + 1
            own[w] += by

    lo, mid, hi = 0, 0, 0
    for gap in range(gaps):
        n = min(around, gap + 1, gaps - gap)
        # the pieces lo..mid-1 are left of the gap, mid..hi-1 right of it
        while hi < gap + 1 + n:
            add(right, left, 1, pieces[hi], 1)
            hi += 1
        while mid < gap + 1:
            add(right, left, 1, pieces[mid], -1)
            add(left, right, 0, pieces[mid], 1)
            mid += 1
        while lo < gap + 1 - n:
            add(left, right, 0, pieces[lo], -1)
            lo += 1
        while hi > gap + 1 + n:
            hi -= 1
            add(right, left, 1, pieces[hi], -1)
        scores.append(dot / math.sqrt(square[0] * square[1]) if dot else 0.0)
    smooth = [sum(scores[max(0, i - 1) : i + 2]) / len(scores[max(0, i - 1) : i + 2]) for i in range(gaps)]
    depths = []
    for i, score in enumerate(smooth):
        peaks = 0.0
        for step in (-1, 1):
            j = i
            while 0 <= j + step < gaps and smooth[j + step] >= smooth[j]:
                j += step
            peaks += smooth[j]
        depths.append(peaks - 2 * score)
    mean = sum(depths) / gaps
    limit = mean - math.sqrt(sum((d - mean) ** 2 for d in depths) / gaps) / 2
    chosen: list[int] = []
    for i in sorted(range(gaps), key=lambda i: (-round(depths[i], 12), i)):
        if depths[i] > max(limit, 1e-12) and all(abs(i - c) >= apart for c in chosen):
            chosen.append(i)
    places = {min(range(len(starts)), key=lambda k: (abs(starts[k] - (i + 1) * width), k)) for i in chosen}
    return sorted(places - {0})


STRATEGIES = ("hybrid", "semantic", "texttiling", "token")


def blocks(body: Column, strategy: str = "hybrid", target: int = 700, overlap: int = 80, least: int = 120, embed: Embedder | None = T.hashed_vector, places: Column | None = None) -> Column:
    """The chunks of a section. semantic and hybrid cut at boundaries first (at the given places, where they are known), texttiling at the given places of
    sentences; token fills windows. All leave code blocks and tables whole."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no strategy {strategy!r}")
    segmented = strategy in ("semantic", "hybrid") and embed is not None and places is None

    def joined(s: Column) -> Column:
        lists = lambda part: pack.merged(part, target, overlap, least)
        if segmented:
            parts = T.bound(boundaries(s, embed), lambda b: _pieces(s, F.concat(F.array(F.lit(0)), b)))
            return F.flatten(F.transform(parts, lists))
        if places is not None:
            return F.flatten(F.transform(_pieces(s, F.concat(F.array(F.lit(0)), places)), lists))
        return lists(s)

    def chunks(x: Column) -> Column:
        found = T.bound(_whole(x), joined)
        texts = F.transform(found, lambda run: T.boundary_cleanup(_restored(F.array_join(run, "\n"), x["blocks"])))
        return F.filter(texts, lambda t: t != "")

    return T.bound(_stashed(body), chunks)


def standalone(docs: DataFrame, keys: list[str], text: str = "text", strategy: str = "hybrid", **options) -> DataFrame:
    """keys, id (chunk_00001 and so on in each document), section, chunk, tokens."""
    clean = T.normalize_whitespace(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")))
    filled = F.filter(headed(clean), lambda s: T.strip(s["body"]) != "")
    split = docs.select(*keys, filled.alias("sections"))
    if given := strategy == "texttiling":
        # Python sees the sentences of all sections of a text at once, with stand-ins for blocks, and gives their places
        sentences = F.transform("sections", lambda s: T.split_sentences(_stashed(s["body"])["text"]))
        split = hashed.added(split.withColumn("sentences", sentences), "tiles", lambda lists: map(tiles, lists), "int", nested=True)
    elif given := strategy in ("semantic", "hybrid") and options.get("embed", T.hashed_vector) is T.hashed_vector:
        split = hashed.added(split.withColumn("sentences", F.transform("sections", lambda s: T.bound(_stashed(s["body"]), _whole))), "tiles", hashed.drops, "int", nested=True)
    else:
        split = split.withColumn("tiles", F.transform("sections", lambda s: F.array().cast(INTS)))
    cut = lambda s, at: F.transform(blocks(s["body"], strategy, places=at if given else None, **options), lambda b: F.struct(s["section"].alias("section"), b.alias("chunk")))
    rows = F.flatten(F.zip_with("sections", "tiles", cut))
    found = split.select(*keys, F.posexplode(rows).alias("no", "c"))
    return found.select(*keys, F.format_string("chunk_%05d", F.col("no") + 1).alias("id"), "c.section", "c.chunk", T.approx_tokens(F.col("c.chunk")).alias("tokens"))


def remerged(chunks: DataFrame, doc: str, order: str, k: int = 1, most: int = 2000, id_: str = "id", text: str = "chunk") -> DataFrame:
    """doc, id, text, merged_from, tokens: each chunk with its k neighbours on either side, joined by blank lines. While
    that exceeds `most` tokens the larger end goes (the left one of equals); merged_from names all of them."""
    near = Window.partitionBy(doc).orderBy(order).rowsBetween(-k, k)
    join = lambda b: F.array_join(b, "\n\n")

    def trim(b: Column, _: Column) -> Column:
        left = T.approx_tokens(F.get(b, F.lit(0))) >= T.approx_tokens(F.element_at(b, -1))
        shorter = F.when(left, F.slice(b, F.lit(2), F.size(b))).otherwise(F.slice(b, F.lit(1), F.size(b) - 1))
        return F.when((T.approx_tokens(join(b)) > most) & (F.size(b) > 1), shorter).otherwise(b)

    found = chunks.select(doc, order, F.col(id_).alias("of"), F.collect_list(text).over(near).alias("texts"), F.collect_list(id_).over(near).alias("merged_from"))
    kept = F.aggregate(F.sequence(F.lit(1), F.lit(2 * k)), F.col("texts"), trim)
    merged = found.select(doc, F.concat(F.lit("merged_"), F.col("of").cast("string")).alias("id"), join(kept).alias("text"), "merged_from")
    return merged.withColumn("tokens", T.approx_tokens(F.col("text")))
