"""N-gram Jaccard join by signature trees (operator 6).

Links two documents when den * |A n B| >= num * |A u B| for their sets of word shingles, and returns
one row per document with its component. No pair is lost and none is made that does not hold:

1. Each document gets a 128-bit digest of its set. Documents with equal sets are one class.
2. Of two linked sets, put in any one order, the first (1 - num / den) of each and one (the prefix) have a token
   in common. In an order that begins with the tokens of one class alone, a class with so many of those links
   with nothing. For most documents the tokens of one hash residue show that already; only they move,
   and of tokens that several documents of a task share one row alone.
3. Of the other classes all tokens are counted, and the rarest shared ones of each prefix are its keys. Connected
   components over shared keys give blocks that hold all links. Up to here a class goes by 64 bits of its digest.
4. Each block is joined by a signature tree (sigtree). Blocks of more than PART sets or TOKENS tokens
   are cut by size class and hash; parts are first joined by themselves together with a pivot for each
   class, then only pairs of neighbouring parts that are not yet one component are joined.
5. Components of the links, spread over the copies of each set.

Rows are told apart by id and text, so ids may repeat or be null.

Edge cases: a null or empty text, or one without words, has an empty set and no links; a text with
fewer than k words has its whole word sequence as its one token; equal rows share a component; rows
that repeat an id with other texts are vertices of their own; component_id is the smallest id that is
not null, null where there is none; of each component one (id, text) is marked kept, as is each of
those with an empty set; empty tables give empty results; only the id and text columns are read, so
other columns cannot clash.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import sigtree, vec
from quarry.llm.graph import components
from quarry.llm.shared import dropped, free, stored, text_hash

#: A task joins so many sets at most, and of sets below this size together so many tokens.
PART, TOKENS = 1500, 4_000_000
#: Classes that a task remembers, so that it sends the tokens of copies once; tokens that it looks at together.
SEEN, TOGETHER = 50_000, 400_000
HASHES = ("t1", "t2")
#: So many rows of tasks (four numbers each) are broadcast at most; more are joined by shuffle.
BROADCAST_IDS = 300_000


def _sets(block: vec.Texts, k: int) -> Iterator[np.ndarray]:
    """The sorted set of tokens of each text."""
    starts, ends, first = block.words()
    hashes = block.hashes(starts, ends, lower=True)
    grams, at = vec.windows(hashes, first, k)
    begin = np.searchsorted(at, first)
    for i, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
        if b > a:
            yield np.unique(grams[a:b])
        else:
            few = hashes[first[i] : first[i + 1]]
            yield vec.windows(few, np.array([0, len(few)]), len(few))[0] if len(few) else few


def _digest(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        both = vec.mix(s + np.uint64(1)).sum(dtype=np.uint64), vec.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return tuple(int(x) for x in np.array(both, np.uint64).view(np.int64))


def residue(num: int, den: int) -> int:
    """One token in so many is looked at first: enough to show that over 1 - num / den of a set are its own."""
    return max(1, 6 * den // (10 * (den - num))) if den > num else 1 << 62


def _some(s: np.ndarray, every: int) -> np.ndarray:
    return s[vec.mix(s ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(every) == 0]


def digested(docs: DataFrame, k: int, every: int, doc_id: str, text: str) -> DataFrame:
    """id, t1, t2 (hashes of the text), n, m (tokens of the residue), d1, d2 (a digest of the set)."""
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ("id", "t1", "t2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in vec.texts(batch.column("text")):
                n, m, d = [], [], []
                for s in _sets(block, k):
                    n.append(len(s))
                    m.append(len(_some(s, every)))
                    d.append(_digest(s))
                rows = batch.slice(block.first, block.n)
                yield pa.RecordBatch.from_pydict({c: rows.column(c) for c in names} | {"n": pa.array(n, pa.int64()), "m": pa.array(m, pa.int64()), "d1": pa.array([x for x, _ in d], pa.int64()), "d2": pa.array([x for _, x in d], pa.int64())})

    return _told_apart(docs, doc_id, text).mapInArrow(run, f"id {kind}, t1 long, t2 long, n long, m long, d1 long, d2 long")


def _told_apart(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("id"), *(h.alias(n) for n, h in zip(HASHES, text_hash(text), strict=True)), F.col(text).alias("text"))


def _tokens(docs: DataFrame, k: int, every: int, text: str, told: bool) -> DataFrame:
    """token, node (64 bits of the digest), n of the tokens of the residue.

    With told, a row with n > 0 says that so many tokens of a node are shared (its token is a stand-in, and told is
    true), and a token that several nodes of a task have is one row with n = 0; other rows have n = 1.
    """

    def rows(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        token, node = np.concatenate(sets), np.repeat(np.array(nodes, np.int64), [len(x) for x in sets])
        one, sure = np.ones(len(token), np.int64), np.zeros(len(token), bool)
        if told:
            order = np.argsort(token)
            token, node = token[order], node[order]
            first = np.concatenate(([True], token[1:] != token[:-1]))
            alone = first & np.concatenate((first[1:], [True]))
            own, times = np.unique(node[~alone], return_counts=True)
            stand_in = vec.mix(own.view(np.uint64))
            token, node, one = np.concatenate((token[first], stand_in)), np.concatenate((node[first], own)), np.concatenate((alone[first].astype(np.int64), times))
            sure = np.arange(len(token)) >= len(token) - len(own)
        return pa.RecordBatch.from_pydict({"token": pa.array(token.view(np.int64)), "node": pa.array(node), "n": pa.array(one), "told": pa.array(sure)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        nodes, sets, size = [], [], 0
        for batch in batches:
            for block in vec.texts(batch.column(0)):
                for s in _sets(block, k):
                    if len(s) and (d := _digest(s)) not in seen:
                        seen.add(d)
                        nodes.append(d[0])
                        sets.append(_some(s, every) if every > 1 else s)
                        size += len(sets[-1])
                if len(seen) > SEEN:
                    seen.clear()
                if size > TOGETHER:
                    yield rows(nodes, sets)
                    nodes, sets, size = [], [], 0
        if size:
            yield rows(nodes, sets)

    return docs.select(text).mapInArrow(run, "token long, node long, n long, told boolean")


def _prefix(num: int, den: int) -> Column:
    """Tokens of a set of n of which one is in each linked set."""
    return F.expr(f"n - ({num} * n + {den - 1}) div {den} + 1")


def candidates(docs: DataFrame, digests: DataFrame, k: int, num: int, den: int, doc_id: str, text: str) -> DataFrame:
    """node, id, t1, t2: one row of each class that may have a partner; the others have too many tokens of their own."""
    every = residue(num, den)
    of = Window.partitionBy("token")
    found = _tokens(docs, k, every, text, told=True)
    shared = found.withColumns({"low": F.min("node").over(of), "high": F.max("node").over(of)}).where("told or low < high")
    counts = shared.groupBy("node").agg(F.sum("n").alias("shared"))
    classes = digests.where("n > 0").groupBy(F.col("d1").alias("node")).agg(F.min(F.struct("id", *HASHES)).alias("at"), F.max("n").alias("n"), F.min("m").alias("m"))
    left = classes.join(counts, "node", "left").where(F.col("m") - F.coalesce("shared", F.lit(0)) < _prefix(num, den))
    return stored(left.select("node", "at.id", "at.t1", "at.t2", "n"), "candidates")


def blocks(docs: DataFrame, some: DataFrame, k: int, num: int, den: int, doc_id: str, text: str) -> DataFrame:
    """node, component: blocks of nodes within which all links lie."""
    texts = _met(_told_apart(docs, doc_id, text), some.select("id", *HASHES), ("id", *HASHES), "left_semi").select("text")
    tokens = _tokens(texts, k, 1, "text", told=False).select("token", "node")
    often = tokens.groupBy("token").agg(F.count("*").alias("often"), F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("token", "often")
    often = stored(often, "shared-tokens")
    shared = tokens.join(often, "token").distinct()
    own = Window.partitionBy("node")
    ranked = shared.withColumns({"rank": F.row_number().over(own.orderBy("often", "token")), "shared": F.count("*").over(own)})
    sizes = some.select("node", "n")
    prefix = ranked.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_IDS else sizes, "node").where(F.col("rank") + F.col("n") - F.col("shared") <= _prefix(num, den))
    keys = stored(prefix.select("token", "node"), "prefixes")
    heads = keys.groupBy("token").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head < last").drop("last")
    found = components(keys.join(heads, "token").select(F.col("node").alias("a"), F.col("head").alias("b")))
    dropped(docs.sparkSession, often, keys)
    return found


def _class(size: str, num: int, den: int) -> Column:
    """Sizes within num / den are in the same class or in neighbouring ones: classes are a little wider."""
    return F.floor(F.log(size) / float(-np.log(num / den) * (1 + 1e-9))).cast("int")


def _met(rows: DataFrame, places: DataFrame, names: tuple[str, ...], how: str) -> DataFrame:
    """rows joined with the rows of places (id, t1, t2), which are broadcast if they are few. names: id, t1 and t2 in rows."""
    side = places.withColumnsRenamed({c: f"at_{c}" for c in ("id", *HASHES)}).alias("p")
    side = F.broadcast(side) if places.count() <= BROADCAST_IDS else side
    same = (F.col(f"r.`{c}`").eqNullSafe(F.col(f"p.at_{at}")) for c, at in zip(names, ("id", *HASHES), strict=True))
    return rows.alias("r").join(side, functools.reduce(lambda x, y: x & y, same), how)


def _joined(docs: DataFrame, tasks: DataFrame, k: int, num: int, den: int, doc_id: str, text: str) -> DataFrame:
    """Links a, b within each task of tasks (task, node, part, known, and id, t1, t2 of its text).

    The sets are made from the texts on the way to their task and are nowhere written as a table.
    """
    names = ("task", "node", "part", "known")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in vec.texts(batch.column("text")):
                rows = batch.slice(block.first, block.n)
                data = [s.tobytes() for s in _sets(block, k)]
                yield pa.RecordBatch.from_pydict({c: rows.column(c) for c in names} | {"tokens": pa.array(data, pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(rows: dict) -> pa.RecordBatch | None:
            nodes = sorted(rows)
            sets = [np.frombuffer(rows[i][0], np.uint64) for i in nodes]
            known = [rows[i][2] for i in nodes]
            group = None if known[0] is None else np.unique(np.array(known), return_inverse=True)[1]
            found = sigtree.links(sets, num, den, group)
            return pa.RecordBatch.from_pydict({"a": pa.array([nodes[i] for i, _ in found], pa.int64()), "b": pa.array([nodes[j] for _, j in found], pa.int64())}) if found else None

        now, rows = None, {}
        for batch in batches:
            for task, node, *row in zip(*(batch.column(c).to_pylist() for c in ("task", "node", "tokens", "part", "known")), strict=True):
                if task != now:
                    if len(rows) > 1 and (out := close(rows)) is not None:
                        yield out
                    now, rows = task, {}
                rows[node] = row  # equal rows once
        if len(rows) > 1 and (out := close(rows)) is not None:
            yield out

    texts = _met(_told_apart(docs, doc_id, text), tasks, ("id", *HASHES), "inner").select(*names, "text")
    return texts.mapInArrow(tokens, "task long, node long, part int, known long, tokens binary").repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def links(docs: DataFrame, members: DataFrame, k: int, num: int, den: int, doc_id: str, text: str) -> DataFrame:
    """Links a, b that join up exactly the linked members. members: node, id, t1, t2, n, block."""
    at = ("id", "t1", "t2")
    plan = members.select("node", *at, "n", "block", _class("n", num, den).alias("class"))
    counts = stored(plan.groupBy("block", "class").agg(F.count("*").alias("n"), F.sum("n").alias("tokens")), "counts")
    whole = counts.groupBy("block").agg(F.sum("n").alias("total"), F.sum("tokens").alias("tokens"))
    large = whole.where((F.col("total") > PART) | ((F.col("tokens") > TOKENS) & (F.col("total") > 2))).select("block")
    none = F.lit(None).cast("long").alias("known")
    task = lambda *c: F.xxhash64(*c).alias("task")
    small = plan.join(large, "block", "left_anti").select(task("block"), "node", *at, F.lit(0).alias("part"), none)
    if not large.take(1):
        return stored(_joined(docs, stored(small, "tasks"), k, num, den, doc_id, text), "links")

    # parts of large blocks: by size class, and by hash where a class has more than PART sets
    parts = F.greatest(F.ceil(F.col("n") / PART), F.least(F.ceil(F.col("tokens") / TOKENS), F.col("n"))).cast("int")
    cut = counts.join(large, "block").select("block", "class", parts.alias("parts"))
    parted = stored(plan.join(cut, ["block", "class"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")), "parted")
    own = F.struct("node", *at)
    least = parted.groupBy("block", "class").agg(F.min_by(own, F.xxhash64(F.lit(3), "node")).alias("p")).select("block", "class", "p.*")
    pivots = least.join(cut, ["block", "class"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("block", "class", "node", *at, "part")
    alone = parted.select("block", "class", "node", *at, "part").unionByName(pivots)
    tasks = small.unionByName(alone.select(task("block", "class", "part"), "node", *at, F.lit(0).alias("part"), none))
    first = stored(_joined(docs, stored(tasks, "tasks"), k, num, den, doc_id, text), "links")

    # pairs of parts of the same or neighbouring classes that are not one component by now
    known = components(first)
    labelled = stored(parted.join(known, "node", "left").withColumn("known", F.coalesce("component", "node")).drop("component"), "labelled")
    state = labelled.groupBy("block", "class", "part").agg(F.min("known").alias("low"), F.max("known").alias("high"))
    other = state.select("block", F.col("class").alias("class2"), F.col("part").alias("part2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    pairs = state.join(other, "block").where(((F.col("class") == F.col("class2")) & (F.col("part") < F.col("part2"))) | (F.col("class") + 1 == F.col("class2")))
    pairs = pairs.where((F.least("low", "low2") != F.greatest("high", "high2"))).withColumn("task", task("block", "class", "part", "class2", "part2"))
    of = pairs.select("block", "class", "part", "task").unionByName(pairs.select("block", F.col("class2").alias("class"), F.col("part2").alias("part"), "task"))
    again = labelled.join(of, ["block", "class", "part"]).select("task", "node", *at, "part", "known")
    return stored(first.unionByName(_joined(docs, stored(again, "tasks"), k, num, den, doc_id, text)), "links")


def jaccard_components(docs: DataFrame, k: int, num: int, den: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, t1, t2 (hashes of the text) of every row of docs."""
    digests = stored(digested(docs, k, residue(num, den), doc_id, text), "digests")
    some = candidates(docs, digests, k, num, den, doc_id, text)
    in_block = blocks(docs, some, k, num, den, doc_id, text).select(F.col("node").alias("d1"), F.col("component").alias("block"))
    members = digests.where("n > 0").join(in_block, "d1").groupBy("d1", "d2").agg(F.min(F.struct("id", "t1", "t2")).alias("at"), F.first("n").alias("n"), F.first("block").alias("block"))
    # numbers are drawn when the table is written, once for each class
    members = stored(members.select(F.monotonically_increasing_id().alias("node"), "d1", "d2", "at.id", "at.t1", "at.t2", "n", "block"), "members")
    found = components(links(docs, members, k, num, den, doc_id, text))
    linked = members.join(found, "node").select("d1", "d2", "component")

    # empty sets link with nothing; all other rows have their class or what it is linked with
    place = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), "t1", "t2").alias("at")
    classes = digests.where("n > 0").groupBy("d1", "d2").agg(F.min(place).alias("at")).join(linked, ["d1", "d2"], "left")
    alone = classes.where("component is null").select("d1", "d2", "at")
    least = classes.where("component is not null").groupBy("component").agg(F.min("at").alias("least"))
    named = stored(alone.unionByName(classes.where("component is not null").join(least, "component").select("d1", "d2", F.col("least").alias("at"))), "classes")
    out = digests.join(named, ["d1", "d2"], "left")
    first = F.col("at.id").eqNullSafe(F.col("id")) & (F.col("at.t1") == F.col("t1")) & (F.col("at.t2") == F.col("t2"))
    full = F.col("n") > 0
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.when(full, F.col("at.id")).otherwise(F.col("id")).alias("component_id"), F.when(full, first).otherwise(True).alias("kept"), "t1", "t2")


def first_of_each(docs: DataFrame, k: int, num: int, den: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, one of each component, without those that have no word.

    Of rows that repeat an id and a text one stays. Columns are kept whatever their names.
    """
    found = jaccard_components(docs, k, num, den, doc_id, text).withColumnRenamed(doc_id, "id")
    found = stored(found.select("id", *HASHES, (F.col("kept") & (F.col("n_shingles") > 0)).alias("stays")), "judged")
    gone = found.where("not stays").select("id", *HASHES).distinct()
    again = found.where("stays").groupBy("id", *HASHES).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    own = free(docs.columns, *HASHES)
    rows = docs.withColumns(dict(zip(own, text_hash(text), strict=True)))
    left = _met(rows, gone, (doc_id, *own), "left_anti")
    if again.take(1):
        repeated = _met(left, again, (doc_id, *own), "left_semi").dropDuplicates([doc_id, *own])
        left = _met(left, again, (doc_id, *own), "left_anti").unionByName(repeated)
    return left.drop(*own)
