"""Packing by optimal length buckets (operator 10).

One global histogram of lengths (exact below EXACT, then EXACT / 2 bins an octave, so at most some ten thousand
rows, each with the number and the largest of its lengths) reaches the driver. A dynamic programme chooses the
at most `buckets` upper bounds among the bins' largest lengths that minimise total padding: the
optimum for lengths below EXACT, above it within 2 / EXACT. Its best cuts move one way only (the cost is
Monge), so each layer takes n log n steps. In each
bucket batches take budget // bound rows, in order of a hash of the id: a batch padded to its
bucket's bound stays within the token budget. A text longer than the budget is a batch by itself.

Ranks are formed in shards of a bucket of about SHARD rows and shifted by the counts of the shards
before, so no task sees a whole bucket and all batches but a bucket's last are full.

Edge cases: lengths that are null or 0 have no bucket (nulls in bucket, bound and batch); repeated
rows are packed each; ids may be null or repeat; empty tables give empty results; other columns are
kept whatever their names, those with the names of the results replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.shared import free, stored

BUCKETS, BUDGET, SHARD, EXACT = 12, 65_536, 2_000, 8192


def _bin(length: str) -> Column:
    """Exact below EXACT, then EXACT / 2 bins to each doubling."""
    n = F.col(length).cast("long")
    shift = F.length(F.bin(n)) - F.lit(EXACT.bit_length() - 1)
    return F.when(n < EXACT, n).otherwise(shift * 2 * EXACT + F.call_function("shiftright", n, F.greatest(shift, F.lit(0)).cast("int")))


def _layer(best: np.ndarray, total: np.ndarray, largest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """min and argmin over i < j of best[i] + (total[j] - total[i]) * largest[j - 1] for all j.

    The places are solved in the order of a bisection, each between the cuts of its neighbours.
    """
    n = len(largest)
    now, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
    now[0] = 0
    step = 1 << n.bit_length()
    while step > 1:
        step //= 2
        j = np.arange(step, n + 1, 2 * step)
        above = j + step
        lo = cut[j - step]
        hi = np.where(above <= n, np.minimum(cut[np.minimum(above, n)], j - 1), j - 1)
        size = hi - lo + 1
        begin = np.concatenate(([0], np.cumsum(size)[:-1]))
        of = np.repeat(np.arange(len(j)), size)
        i = np.arange(size.sum()) - begin[of] + lo[of]
        cost = best[i] + (total[j[of]] - total[i]) * largest[j[of] - 1]
        now[j] = np.minimum.reduceat(cost, begin)
        hit = np.flatnonzero(cost == now[j][of])
        some, first = np.unique(of[hit], return_index=True)
        cut[j[some]] = i[hit[first]]
    return now, cut


def boundaries(largest: np.ndarray, count: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds that minimise sum(count * (bound - length)) for ascending lengths.

    The sum of the lengths is the same for all choices, so padded size alone is minimised.
    """
    n = len(largest)
    total = np.concatenate(([0.0], np.cumsum(count, dtype=np.float64)))
    best = np.full(n + 1, np.inf)
    best[0] = 0
    cuts: list[np.ndarray] = []
    for _ in range(min(buckets, n)):
        best, cut = _layer(best, total, np.asarray(largest, np.float64))
        cuts.append(cut)
    out, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        out.append(int(largest[j - 1]))
        j = int(cut[j])
    return sorted(out)


def pack(docs: DataFrame, length: str = "length", doc_id: str = "doc_id", buckets: int = BUCKETS, budget: int = BUDGET, shard_rows: int = SHARD) -> DataFrame:
    """All columns, bucket (from 0), bound, and batch (from 0 in each bucket)."""
    new = ("bucket", "bound", "batch")
    docs = stored(docs.drop(*new), "pack")
    histogram = docs.where(F.col(length) > 0).groupBy(_bin(length).alias("bin")).agg(F.max(length).alias("largest"), F.count("*").alias("n"))
    rows = sorted((r.largest, r.n) for r in histogram.collect())  # some thousand bins at most
    if not rows:
        return docs.select("*", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("long").alias("bound"), F.lit(None).cast("long").alias("batch"))
    largest, count = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    bounds = boundaries(largest, count, buckets)
    sizes = [int(count[(largest <= b) & (largest > a)].sum()) for a, b in zip([0, *bounds], bounds, strict=False)]
    pick = lambda values: F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col("bucket") + 1)
    bucket = F.when(F.col(length) > 0, F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col(length))))
    order = F.xxhash64(F.lit(11), F.col(doc_id), F.col(length))
    shard, rank, before = free([*docs.columns, *new], "shard", "rank", "before")
    of = F.pmod(order, pick([max(1, -(-n // shard_rows)) for n in sizes]))
    # rows without a length are dealt by hash and have no batch
    placed = docs.withColumn("bucket", bucket).withColumn("bound", pick(bounds)).withColumn(shard, F.coalesce(of, F.pmod(F.xxhash64(F.lit(12), F.col(doc_id)), F.lit(1 << 20))))
    placed = placed.withColumn(rank, F.row_number().over(Window.partitionBy("bucket", shard).orderBy(order, doc_id)))
    counts = placed.where("bucket is not null").groupBy("bucket", shard).agg(F.count("*").alias("n"))
    counts = counts.select("bucket", shard, (F.sum("n").over(Window.partitionBy("bucket").orderBy(shard)) - F.col("n")).alias(before))
    joined = placed.join(counts, ["bucket", shard], "left")
    batch = F.floor((F.col(before) + F.col(rank) - 1) / pick([max(1, budget // b) for b in bounds])).cast("long")
    return joined.select(*docs.columns, "bucket", "bound", batch.alias("batch"))
