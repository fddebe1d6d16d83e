"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Only edges and labels move, always by shuffle; the driver sees a row count and a checksum a round.
Each round is written to the shared folder, so plans stay short and a lost executor costs a reread.
Components of any diameter take a number of rounds that grows with its logarithm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import dropped, stored

ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) of every node that has an edge to another."""
    low, high = F.least(a, b), F.greatest(a, b)
    now = stored(edges.where(F.col(a) != F.col(b)).select(high.alias("u"), low.alias("v")).distinct(), "edges")
    before = None
    for _ in range(ROUNDS):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: the larger neighbours of u point to the least of u and its neighbours
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours point to the least of those
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        after = stored(small.where(F.col("u") != F.col("v")).distinct(), "edges")
        state = after.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        dropped(edges.sparkSession, now)
        now = after
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
