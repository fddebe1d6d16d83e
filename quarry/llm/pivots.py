"""Exact top-k by inner product with pivot tables (operator 12).

Vectors become whole numbers. Distances to `pivots` vectors and to the origin are worked out once for every vector, the pivot table: |d(q, p) - d(x, p)| is
at most d(q, x) for each pivot p, so the largest of these bounds d(q, x) from below, and as q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2, it bounds the score from above.

Candidates lie in units: vectors of one length and nearest pivot, cut by hash into parts of about UNIT bytes. (1) A query takes a unit of
its own nearest pivot, which gives it a score that k candidates reach at least. (2) The range of each distance in a unit bounds the score of all of it:
queries, in blocks of about ASKING, meet summaries of GROUP units and learn which units can still matter. (3) They go to those units, and take the
candidates of each in the order of their bounds until the next bound is below their k-th score. A unit gives a query k rows at most, and a
window merges them. Candidates are read row by row in sorted order, a task holds one unit at a time, and queries stream past it.

Results are exact: products are taken in float64 while they stay below 2^53, else in Python's integers, and bounds carry a margin for rounding.

Edge cases: vectors that are null, empty, or hold null or non-finite components (also once scaled) take no part; vectors of different lengths do not meet;
repeated rows are rows of their own: each one asks, and each is a candidate of the other; a null id never asks and comes last among equal scores; scores
beyond a long count as the largest or smallest long; fewer than k candidates give as many rows; empty tables give no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.centroids import exact, narrow
from quarry.llm.shared import dropped, stored

#: Bytes of a unit as float64, units a group of summaries, queries that look at a group in one task, candidates a step.
UNIT, GROUP, ASKING, STEP = 4 << 20, 512, 4096, 256
#: So many (length, nearest pivot) groups are broadcast with their sizes; more are joined by shuffle.
FEW = 10_000
LONG = (1 << 63) - 1
_HUGE = np.finfo(np.float64).max


def distances_to(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """In float32; what is beyond it counts as its largest number, which keeps differences below the true ones."""
    with np.errstate(all="ignore"):
        square = (x * x).sum(1)[:, None] - 2 * (x @ points.T) + (points * points).sum(1)
        return np.nan_to_num(np.sqrt(np.maximum(square, 0)).astype(np.float32), posinf=np.finfo(np.float32).max)


def upper(gap: np.ndarray, size: np.ndarray, norm: np.ndarray | float, q_norm: np.ndarray | float) -> np.ndarray:
    """What a score is at most, from differences of distances (one column a pivot) and squared norms.

    float32 has 24 bits and a squared distance near zero half the bits of its parts, so that a millionth of the sizes
    that enter is taken off the differences; scores are whole, and one is added.
    """
    with np.errstate(all="ignore"):
        near = np.maximum(gap - 1e-6 * (size + np.sqrt(norm + q_norm)[:, None]), 0).max(1)
        return np.nan_to_num((norm + q_norm - near * near) / 2 + 1 + 1e-9 * (norm + q_norm), nan=np.inf, posinf=np.inf)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers: exact, or the end of their range."""
    if x.shape[1] * float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) < 1 << 53:
        return (x @ q).astype(np.int64)
    return np.array([max(-LONG - 1, min(LONG, v)) for v in exact(x) @ exact(q)], np.int64)


class Unit:
    """The candidates of a unit."""

    def __init__(self, rows: list[dict]):
        self.x = np.stack([np.frombuffer(r["data"], r["kind"]) for r in rows]).astype(np.float64)
        self.far = np.stack([np.frombuffer(r["far"], np.float32) for r in rows]).astype(np.float64)
        self.ids, self.rows = [r["id"] for r in rows], np.array([r["row"] for r in rows], np.int64)
        # ids as numbers that order them, nulls last
        self.rank = np.array([LONG if i is None else i for i in self.ids], np.int64)
        with np.errstate(over="ignore"):
            self.norm = (self.x * self.x).sum(1)

    def best(self, q: np.ndarray, q_row: int, q_far: np.ndarray, floor: int, k: int) -> list[tuple[int, int]]:
        """(score, place) of the candidates that can be among the first k of a query, all of at least `floor`."""
        with np.errstate(over="ignore"):
            most = upper(np.abs(self.far - q_far), self.far + q_far, self.norm, float(q @ q))
        most[self.rows == q_row] = -np.inf
        order = np.argsort(-most, kind="stable")
        scores, places = np.empty(0, np.int64), np.empty(0, np.int64)
        for lo in range(0, len(order), STEP):
            at = order[lo : lo + STEP]
            at = at[(most[at] >= floor) & (most[at] > -np.inf)]
            if not len(at):
                break
            scores, places = np.concatenate((scores, products(self.x[at], q))), np.concatenate((places, at))
            scores, places = scores[scores >= floor], places[scores >= floor]
            if len(scores) >= k:
                top = np.lexsort((self.rows[places], self.rank[places], ~scores))[:k]  # ~ turns the order without an overflow
                scores, places = scores[top], places[top]
                floor = max(floor, int(scores[-1]))
        return list(zip(scores.tolist(), places.tolist(), strict=True))


def _streamed(held: DataFrame, asking: DataFrame, keys: list[str], meet: Callable[[list[dict], Iterator[dict]], Iterator[tuple]], schema: str, types: list[pa.DataType]) -> DataFrame:
    """meet(held rows, asking rows) of each key; only the held rows of one key are in memory at a time."""
    both = held.withColumn("tag", F.lit(0)).unionByName(asking.withColumn("tag", F.lit(1)), allowMissingColumns=True)
    both = both.repartition(*keys).sortWithinPartitions(*keys, "tag")
    names = [part.split(" ")[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, ready = None, [], None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                at = tuple(r[c] for c in keys)
                if at != now:
                    now, own, ready = at, [], None
                if r["tag"] == 0:
                    own.append(r)
                elif own:
                    ready = ready or meet(own)
                    out += ready(r)
            columns = list(zip(*out, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return both.mapInArrow(run, schema)


def top_k(vectors: DataFrame, asks: Column, k: int = 10, scale: int = 1024, pivots: int = 32, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: of each row for which `asks` holds (a condition on the columns) the k best other rows, ties to smaller ids (whole numbers)."""
    spark, v = vectors.sparkSession, F.col(embedding).cast("array<double>")
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < _HUGE / scale))
    valid = vectors.select(F.col(vec_id).cast("long").alias("id"), F.coalesce(asks & F.col(vec_id).isNotNull(), F.lit(False)).alias("asks"), v.alias("v")).where(F.coalesce(fine, F.lit(False)))
    chosen = [np.floor(np.array(r.v) * scale) for r in valid.orderBy(F.xxhash64("v"), "v").select("v").limit(pivots).collect()]  # `pivots` rows
    points = {d: np.stack([np.zeros(d), *(p for p in chosen if len(p) == d)]) for d in {len(p) for p in chosen}}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("v").value_lengths().to_numpy()
            starts = np.cumsum(sizes) - sizes
            flat = np.floor(batch.column("v").flatten().to_numpy() * scale)
            n = len(sizes)
            home, kind, data, far, norm = [0] * n, [""] * n, [b""] * n, [b""] * n, [0.0] * n
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                x = flat[(starts[at][:, None] + np.arange(d)).ravel()].reshape(-1, d)
                away = distances_to(x, points.get(d, np.zeros((1, d))))
                for i, row, f in zip(at.tolist(), x, away, strict=True):
                    small = narrow(row)
                    home[i] = int(f[1:].argmin()) + 1 if len(f) > 1 else 0
                    kind[i], data[i], far[i] = small.dtype.str, small.tobytes(), f.tobytes()
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("row", "id", "asks")} | {"d": pa.array(sizes, pa.int32()), "home": pa.array(home, pa.int32()), "kind": kind, "data": pa.array(data, pa.binary()), "far": pa.array(far, pa.binary())})

    measured = stored(valid.withColumn("row", F.monotonically_increasing_id()).mapInArrow(measure, "row long, id long, asks boolean, d int, home int, kind string, data binary, far binary"), "pivot-table")
    parts = stored(measured.groupBy("d", "home").agg(F.ceil(F.count("*") * F.max("d") * 8 / UNIT).cast("int").alias("parts"), F.count(F.when(F.col("asks"), 1)).alias("asking")), "units")
    small = lambda df, n: F.broadcast(df) if n <= FEW else df
    n_parts = parts.count()
    placed = measured.join(small(parts.drop("asking"), n_parts), ["d", "home"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    wide = ["d", "home", "part", "row", "id", "kind", "data", "far"]
    asking = measured.where("asks")

    def seed(own: list[dict]):
        unit = Unit(own)

        def ask(r: dict) -> list[tuple]:
            found = unit.best(np.frombuffer(r["data"], r["kind"]).astype(np.float64), r["row"], np.frombuffer(r["far"], np.float32).astype(np.float64), -LONG - 1, k)
            return [(r["row"], found[-1][0] if len(found) == k else -LONG - 1)]

        return ask

    floors = stored(_streamed(placed.where("part = 0").select(*wide), asking.select("d", "home", "row", "id", "kind", "data", "far"), ["d", "home"], seed, "row long, floor long", [pa.int64(), pa.int64()]), "floors")
    queries = stored(asking.join(floors, "row", "left").select("row", "id", "d", "kind", "data", "far", F.coalesce("floor", F.lit(-LONG - 1)).alias("floor")), "queries")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the rows of a batch, for each unit and pivot the least and largest distance, and the largest norm."""
        for batch in batches:
            of: dict[tuple, list] = {}
            for r in batch.to_pylist():
                of.setdefault((r["d"], r["home"], r["part"]), []).append(r)
            out = []
            for at, rows in of.items():
                unit = Unit(rows)
                low, high, norm = unit.far.min(0), unit.far.max(0), float(unit.norm.max())
                out += [(*at, p, x, y, norm) for p, (x, y) in enumerate(zip(low.tolist(), high.tolist(), strict=True))]
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 4 + [pa.float64()] * 3, strict=True)], ["d", "home", "part", "pivot", "low", "high", "norm"])

    partial = placed.select(*wide).mapInArrow(ranges, "d int, home int, part int, pivot int, low double, high double, norm double")
    per_pivot = partial.groupBy("d", "home", "part", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("norm").alias("norm"))
    units = per_pivot.groupBy("d", "home", "part").agg(F.array_sort(F.collect_list(F.struct("pivot", "low", "high"))).alias("span"), F.max("norm").alias("norm"))  # `pivots` entries
    blocks = parts.groupBy("d").agg(F.ceil(F.sum("parts") / GROUP).cast("int").alias("groups"), F.ceil(F.sum("asking") / ASKING).cast("int").alias("splits")).where("splits > 0")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    summaries = units.join(small(blocks, n_parts), "d").withColumn("group", F.pmod(F.xxhash64("home", "part"), F.col("groups")).cast("int")).withColumn("split", each("splits")).drop("groups", "splits")
    looking = queries.join(small(blocks, n_parts), "d").withColumn("split", F.pmod(F.xxhash64("row"), F.col("splits")).cast("int")).withColumn("group", each("groups")).drop("groups", "splits", "id")

    def choose(own: list[dict]):
        low, high = (np.array([[p[c] for p in u["span"]] for u in own]) for c in ("low", "high"))
        norm = np.array([u["norm"] for u in own])

        def ask(r: dict) -> list[tuple]:
            q, far = np.frombuffer(r["data"], r["kind"]).astype(np.float64), np.frombuffer(r["far"], np.float32).astype(np.float64)
            with np.errstate(over="ignore"):
                most = upper(np.maximum(low - far, far - high), high + far, norm, float(q @ q))
            return [(r["row"], own[i]["home"], own[i]["part"]) for i in np.flatnonzero(most >= r["floor"]).tolist()]

        return ask

    pairs = _streamed(summaries, looking, ["d", "group", "split"], choose, "row long, home int, part int", [pa.int64(), pa.int32(), pa.int32()])

    def score(own: list[dict]):
        unit = Unit(own)

        def ask(r: dict) -> list[tuple]:
            found = unit.best(np.frombuffer(r["data"], r["kind"]).astype(np.float64), r["row"], np.frombuffer(r["far"], np.float32).astype(np.float64), r["floor"], k)
            return [(r["row"], r["id"], unit.ids[p], s, int(unit.rows[p])) for s, p in found]

        return ask

    found = stored(_streamed(placed.select(*wide), pairs.join(queries, "row"), ["d", "home", "part"], score, "asked long, query_id long, id long, score long, row long", [pa.int64()] * 5), "found")
    dropped(spark, measured, parts, floors, queries)
    order = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row"))
    return found.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
