"""Near-duplicate vectors by random-hyperplane signs in several tables (operator 7).

Vectors of one label whose signs agree on all planes of a table share a bucket of that table; all
pairs in a bucket are verified by exact cosine in double precision. A pair that meets in several
tables counts in the first only. Vectors that are equal, component by component, are first collapsed
to one with a weight, so exact copies cost nothing however many they are. Buckets of more than PART
vectors are cut in parts and joined part against part (no pair of a bucket is lost, and what leaves a
task is a count for each vector and a spanning forest, never all pairs).

Planes per table follow the number of vectors, so that buckets hold a few dozen unrelated vectors at
any size, and tables follow from the wanted recall at the threshold:
recall = 1 - (1 - p^planes)^tables with p = 1 - acos(threshold) / pi.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows
without a label, link with nothing and are kept; vectors of different lengths do not link; repeated
rows of one id and vector count as one vector, and rows of one id with different vectors as several, whose links are
summed and whose component is the smallest; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.graph import components
from quarry.llm.shared import stored

PART = 2000
SEED = 20_24


def tables_for(planes: int, threshold: float, recall: float) -> int:
    meet = (1 - math.acos(threshold) / math.pi) ** planes
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def planes_for(n: int) -> int:
    return min(24, max(6, math.ceil(math.log2(max(n, 2) / 32))))


def codes(vectors: np.ndarray, planes: int, tables: int) -> np.ndarray:
    """(vectors, tables) codes; the planes depend on the seed and the number of dimensions alone."""
    rng = np.random.default_rng([SEED, vectors.shape[1]])
    signs = vectors @ rng.standard_normal((vectors.shape[1], planes * tables)) >= 0
    return signs.reshape(len(vectors), tables, planes) @ (1 << np.arange(planes, dtype=np.int64))


def _unit(raw: list[bytes]) -> np.ndarray:
    v = np.stack([np.frombuffer(r[1:], np.float32 if r[:1] == b"f" else np.float64) for r in raw]).astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow of the squares
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _bucket_pairs(rows: list[tuple], table: int, two: bool, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Of one task: weighted links of each row, and links that span its components.

    rows: (id, weight, codes, vector, side). two: only pairs of different sides.
    """
    unit = _unit([r[3] for r in rows])
    code = np.array([r[2] for r in rows])
    weight = np.array([r[1] for r in rows], np.int64)
    side = np.array([r[4] for r in rows])
    n, count, found = len(rows), np.zeros(len(rows), np.int64), []
    root = np.arange(n)
    for lo in range(0, n, 256):
        near = unit[lo : lo + 256] @ unit.T >= threshold
        for t in range(table):
            near &= code[lo : lo + 256, t][:, None] != code[:, t][None, :]
        if two:
            near &= side[lo : lo + 256][:, None] != side[None, :]
        own = np.arange(lo, min(lo + 256, n))
        near[own - lo, own] = False
        count[own] += near @ weight
        for i in own:
            for r in np.unique(root[near[i - lo]]):
                if r != root[i]:
                    found.append((int(i), int(np.flatnonzero(near[i - lo] & (root == r))[0])))
                    root[root == r] = root[i]
    return count, found


def near_vectors(df: DataFrame, threshold: float = 0.98, recall: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of df."""
    single = df.schema[embedding].dataType.simpleString() == "array<float>"
    v = F.col(embedding).cast("array<float>" if single else "array<double>")
    fine = F.coalesce(F.size(v) > 0, F.lit(False)) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(vec_id).alias("id"), v.alias("v"), F.col(label).cast("string").alias("label"))
    valid = rows.where(fine & F.col("label").isNotNull() & F.col("id").isNotNull())
    # -0.0 equals 0.0
    same = F.transform("v", lambda x: x + F.lit(0.0).cast("float" if single else "double"))
    keyed = stored(valid.select("id", "label", same.alias("v")).withColumns({"h1": F.xxhash64("label", "v"), "h2": F.xxhash64(F.lit(5), "label", "v")}), "vectors")
    members = keyed.select("id", "h1", "h2").distinct()
    classes = members.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    # numbers are drawn when the table is written, once for each class
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    reps = keyed.join(classes.withColumnRenamed("rep", "id"), ["h1", "h2", "id"]).select("node", "label", "v", "weight").dropDuplicates(["node"])

    planes = planes_for(classes.count())
    tables = tables_for(planes, threshold, recall)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 2000):
                batch = big.slice(lo, 2000)
                column, ends = batch.column("v"), np.concatenate(([0], np.cumsum(batch.column("v").value_lengths().to_numpy())))
                flat = column.flatten().to_numpy()
                vectors = [flat[x:y] for x, y in zip(ends, ends[1:], strict=False)]
                code: list = [None] * len(vectors)
                for d in {len(x) for x in vectors}:
                    at = [i for i, x in enumerate(vectors) if len(x) == d]
                    for i, c in zip(at, codes(np.stack([vectors[i] for i in at]).astype(np.float64), planes, tables), strict=True):
                        code[i] = c.tolist()
                kept = {c: batch.column(c) for c in ("node", "label", "weight")}
                raw = [(b"f" if single else b"d") + x.tobytes() for x in vectors]
                yield pa.RecordBatch.from_pydict(kept | {"d": pa.array([len(x) for x in vectors], pa.int32()), "codes": pa.array(code, pa.list_(pa.int64())), "vector": pa.array(raw, pa.binary())})

    signs = stored(reps.mapInArrow(signed, "node long, label string, weight long, d int, codes array<long>, vector binary"), "signs")
    # narrow rows find the buckets of more than one; only for those do vectors move
    slots = signs.select("node", "label", "d", F.posexplode("codes").alias("table", "code"))
    bucket = ["label", "d", "table", "code"]
    counted = slots.groupBy(*bucket).agg(F.count("*").alias("size")).where("size > 1").withColumn("parts", F.ceil(F.col("size") / PART).cast("int"))
    inside = slots.join(counted, bucket).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # part p meets every part q: the task of (p, q) has p <= q, and q = p is the part by itself
    met = inside.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("node", "table", F.col("part").alias("side"), (F.col("part") != F.col("q")).alias("two"), F.xxhash64(*bucket, F.least("part", "q"), F.greatest("part", "q")).alias("task"))
    met = met.join(signs.select("node", "weight", "codes", "vector"), "node")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(rows: list[tuple], table: int, two: bool) -> pa.RecordBatch:
            count, found = _bucket_pairs(rows, table, two, threshold)
            at = np.flatnonzero(count)
            nodes = [rows[i][0] for i in at]
            return pa.RecordBatch.from_pydict({"a": pa.array(nodes + [rows[i][0] for i, _ in found], pa.int64()), "b": pa.array([None] * len(nodes) + [rows[j][0] for _, j in found], pa.int64()), "n": pa.array(count[at].tolist() + [0] * len(found), pa.int64())})

        now, rows = None, []
        for batch in batches:
            for task, table, two, *row in zip(*(batch.column(c).to_pylist() for c in ("task", "table", "two", "node", "weight", "codes", "vector", "side")), strict=True):
                if now != (task, table, two):
                    if len(rows) > 1:
                        yield close(rows, *now[1:])
                    now, rows = (task, table, two), []
                rows.append(tuple(row))
        if len(rows) > 1:
            yield close(rows, *now[1:])

    found = stored(met.repartition("task").sortWithinPartitions("task").mapInArrow(joined, "a long, b long, n long"), "links")
    direct = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    linked = components(found.where("b is not null").select("a", "b"))
    least = linked.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    linked = linked.join(least, "component").select("node", "least")
    by_class = classes.join(direct, "node", "left").join(linked, "node", "left").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    named = members.join(by_class, ["h1", "h2"]).groupBy("id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = df.select(F.col(vec_id).alias("id")).join(named, "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
