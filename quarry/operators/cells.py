"""A stored index of vectors in cells, searched exactly.

A vector lies in the cell of its nearest centre, with its distance from there (`away`). As q·x = q·c + q·(x - c), no vector scores
above q·c + |q| away, and none of a cell above q·c + |q| radius. A search takes the cells in the order of their bounds: the first ones, which
hold FIRST times as many vectors as are asked for, give an n-th score, and only cells that could beat or tie it are read after them, of those
only vectors that could. Cells are folders, so others are not opened; in a file rows are sorted by `away`. The rows are those of a look at all vectors.

Centres are fitted with the first batch to a sample of vectors (those with the smallest hashes of their keys, SAMPLE bytes at most); every vector is stored. Batches
after it add to the same cells and read only themselves and the centres. Once there are GROWTH times as many vectors as the centres
were fitted for, all are laid anew by one commit, so that a row is moved a logarithmic number of times.

Edge cases: vectors that are null, hold null or non-finite components or have another length than most of the first batch are
stored but not found; zero vectors and repeated rows are like any other; ties go to the smaller key; an index
without vectors finds nothing; other columns are not read. Vectors so large that a distance overflows are read by every search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.sources import store
from quarry.sources.log import Conflict, Log, Run, State

#: At most so many cells, and so many bytes of a sample, which the driver holds to fit the centres.
MOST, SAMPLE, ROUNDS = 1024, 64 << 20, 4
FIRST, GROWTH = 4, 16
#: Scores are rounded to so many digits, as in search.py.
DIGITS = 9
#: How tables are split into folders.
SPLIT = {"vectors": "cell"}


def schemas(key: str, key_type: str) -> dict[str, str]:
    return {"vectors": f"{key} {key_type}, vector array<double>, away double, cell int", "cells": "cell int, n long, radius double", "centres": "cell int, centre array<double>"}


def _laid(rows: DataFrame) -> DataFrame:
    """Ranges go to a task, so a cell with a large share of the rows is spread over several."""
    return rows.repartitionByRange("cell", "away").sortWithinPartitions("cell", "away")


LAID = {"vectors": _laid, "cells": lambda rows: rows.groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))}


def _sound(lists: pa.ListArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold `size` finite components, and the matrix of them."""
    full = np.flatnonzero(pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False) == size)
    x = pc.list_flatten(lists.take(pa.array(full))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    good = np.isfinite(x).all(1)
    return full[good], x[good]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return (x @ centres.T - (centres**2).sum(1) / 2).argmax(1)


def centres_of(rows: DataFrame, key: str) -> np.ndarray:
    """Centres for rows of (key, vector); none if no vector can be found."""
    sizes = rows.where(F.size("vector") > 0).groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return np.empty((0, 0))
    size, number = sizes["size"], min(MOST, max(1, math.isqrt(sizes["count"])), max(1, SAMPLE // (8 * sizes["size"])))
    fit = rows.where((F.size("vector") == size) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(1e150))))
    sample = fit.orderBy(F.xxhash64(key), key).limit(min(64 * number, max(1, SAMPLE // (8 * size)))).select("vector").collect()
    if not sample:
        return np.zeros((1, size))
    x = np.array([r.vector for r in sample])
    centres = np.unique(x[:number], axis=0)
    for _ in range(ROUNDS):
        of = _nearest(x, centres)
        n = np.bincount(of, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def placed(rows: DataFrame, centres: np.ndarray, key: str) -> DataFrame:
    """key, vector, away, cell of rows of (key, vector). What cannot be found has cell -1."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, away = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            for lo in range(0, batch.num_rows if len(centres) else 0, 2048):
                at, x = _sound(batch.column(1).slice(lo, 2048), centres.shape[1])
                best = _nearest(x, centres)
                with np.errstate(over="ignore"):
                    far = np.sqrt(((x - centres[best]) ** 2).sum(1)) * (1 + 1e-9)
                cell[lo + at], away[lo + at] = best, far
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(away), pa.array(cell)], [key, "vector", "away", "cell"])

    return rows.mapInArrow(run, schemas(key, kind)["vectors"])


def stored(log: Log, state: State, rows: DataFrame, key: str, afresh: bool = False) -> tuple[list[Run], dict]:
    """The runs of a batch of (key, vector) and the counts with it added to those of `state`; with afresh, cells of their own instead of the state's."""
    rows = rows.select(key, F.col("vector").cast("array<double>").alias("vector"))
    kind = rows.schema[key].dataType.simpleString()
    known, runs = [] if afresh else state.of("centres"), []
    if known:
        table = log.read(known, schemas(key, kind)["centres"]).orderBy("cell").collect()  # at most MOST
        centres = np.array([r.centre for r in table])
    else:
        centres = centres_of(rows, key)
        if len(centres):
            runs.append(log.write("centres", log.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], schemas(key, kind)["centres"]).coalesce(1)))
    vectors = log.write("vectors", _laid(placed(rows, centres, key)), by=SPLIT["vectors"])
    own = log.read([vectors], schemas(key, kind)["vectors"]).where("cell >= 0")
    held = own.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()  # a row a cell, at most MOST
    cells = log.write("cells", log.spark.createDataFrame(held, schemas(key, kind)["cells"]).coalesce(1))
    n, before = sum(r.n for r in held), 0 if afresh else state.info.get("n_vectors", 0)
    info = {"n_vectors": before + n, "vector_key_type": kind} | ({} if known else {"n_fitted": before + n})
    return [*runs, vectors, cells], info


def laid_anew(log: Log, key: str) -> State:
    """New cells for all vectors where they have outgrown theirs. A writer that commits in between goes first; the next call finds the same need."""
    state = log.state()
    if state.info.get("n_vectors", 0) < GROWTH * max(1, state.info.get("n_fitted", 1)):
        return state
    rows = log.read(state.of("vectors"), schemas(key, state.info["vector_key_type"])["vectors"])
    runs, info = stored(log, state, rows, key, afresh=True)
    try:
        return log.commit(state, runs, [r for t in ("vectors", "cells", "centres") for r in state.of(t)], info)
    except Conflict:
        return log.state()


def extend(vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding") -> Cells:
    """Adds the vectors to the index at the path (made if there is none), all or none of them."""
    spark = vectors.sparkSession
    store.claim(spark, path)
    log, rows = Log(spark, path), vectors.select(key, F.col(vector).alias("vector"))
    while True:
        state = log.state()
        runs, info = stored(log, state, rows, key)
        try:
            log.commit(state, runs, info=info)
            break
        except Conflict:  # the other writer may have fitted the centres
            continue
    log.merge({t: s for t, s in schemas(key, info["vector_key_type"]).items() if t in LAID}, LAID, SPLIT)
    return Cells(log, laid_anew(log, key), key)


@dataclass(frozen=True)
class Look:
    """What a search found (key, score), and how many cells and vectors were in the cells that it read."""

    rows: DataFrame
    cells_read: int
    cells: int
    vectors_read: int


@dataclass(frozen=True)
class Cells:
    """A version of an index."""

    log: Log
    state: State
    key: str

    @staticmethod
    def read(spark: SparkSession, path: str, key: str = "vec_id") -> Cells:
        log = Log(spark, path)
        return Cells(log, log.state(), key)

    def _table(self, name: str) -> DataFrame:
        return self.log.read(self.state.of(name), schemas(self.key, self.state.info.get("vector_key_type", "string"))[name])

    def vectors(self) -> DataFrame:
        """key, vector of all that is stored."""
        return self._table("vectors").select(self.key, "vector")

    def nearest(self, query: list[float], n: int, score: str = "dot") -> DataFrame:
        """key, score of the n best by the dot product, clamped at 0, or 2 dot - 1 clamped at 0 (l2)."""
        return self.look(query, n, score).rows

    def look(self, query: list[float], n: int, score: str = "dot") -> Look:
        rows, kind = self._table("vectors"), self.state.info.get("vector_key_type", "string")
        centres = np.array([r.centre for r in self._table("centres").orderBy("cell").collect()])  # at most MOST
        cells = self._table("cells").groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).orderBy("cell").collect()
        if not cells or n < 1:
            return Look(self.log.spark.createDataFrame([], f"{self.key} {kind}, score double"), 0, len(cells), 0)
        q = np.array(query, np.float64)
        if q.shape != centres.shape[1:] or not np.isfinite(q).all():
            raise ValueError(f"a query is a vector of {centres.shape[1]} finite numbers")
        of, sizes, radius = (np.array([r[c] for r in cells]) for c in ("cell", "n", "radius"))
        length, middle = math.sqrt(q @ q), centres[of] @ q
        with np.errstate(over="ignore", invalid="ignore"):
            slack = 2 * 10.0**-DIGITS + 1e-12 * length * (np.sqrt((centres[of] ** 2).sum(1)) + radius)
            bound = middle + length * radius + slack
        bound = np.where(np.isnan(bound) | np.isinf(radius), np.inf, bound)
        order = np.argsort(-bound, kind="stable")
        first = order[: int(np.searchsorted(np.cumsum(sizes[order]), FIRST * n)) + 1]
        best = self._best(self._scored(rows.where(F.col("cell").isin(of[first].tolist())), query, score), n)
        found = best.collect()  # n rows, which the search returns
        done = self.log.spark.createDataFrame(found, best.schema)
        rest, least = order[len(first) :], self._least(found[-1].score if len(found) == n else -math.inf, score)
        rest = rest[bound[rest] >= least]
        seen = np.concatenate([first, rest])
        if not len(rest):
            return Look(done, len(seen), len(cells), int(sizes[seen].sum()))
        near = np.zeros(len(centres))
        if length > 0 and least > -math.inf:
            with np.errstate(over="ignore", invalid="ignore"):
                near[of[rest]] = np.nan_to_num((least - slack[rest] - middle[rest]) / length, nan=0.0, posinf=0.0, neginf=0.0) * (1 - 1e-9)
        near = np.maximum(near, 0)
        some = rows.where(F.col("cell").isin(of[rest].tolist()) & (F.col("away") >= float(near[of[rest]].min())))
        some = some.where(F.col("away") >= F.element_at(F.lit(near.tolist()), F.col("cell") + 1))
        return Look(self._best(done.unionByName(self._scored(some, query, score)), n), len(seen), len(cells), int(sizes[seen].sum()))

    def _scored(self, rows: DataFrame, query: list[float], score: str) -> DataFrame:
        d = T.dot(F.col("vector"), F.array(*[F.lit(float(x)) for x in query]))
        s = {"dot": d, "clamped": F.greatest(F.lit(0.0), d), "l2": F.greatest(F.lit(0.0), 2 * d - 1)}[score]
        return rows.select(self.key, F.round(s, DIGITS).alias("score"))

    def _best(self, scores: DataFrame, n: int) -> DataFrame:
        return scores.orderBy(F.desc("score"), self.key).limit(n)

    @staticmethod
    def _least(worst: float, score: str) -> float:
        """The smallest dot product of a vector that can score so much; at the clamp, any."""
        if score != "dot" and worst <= 0:
            return -math.inf
        return (worst + 1) / 2 if score == "l2" else worst
