"""Near copies over a whole corpus, in an order: a chunk goes if one like it was kept before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.sources.store import fresh, removed

FRONT = 16


#: So many ids are broadcast at most; more are joined by shuffle.
FEW_IDS = 1_000_000


def _of(sets: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of sets with (or without) one of the ids, found where they lie if the ids are few."""
    return sets.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, "id", how)


def _alike(pairs: DataFrame, sets: DataFrame, over: float) -> DataFrame:
    """Of pairs of ids, those whose sets are alike. Only sets of the pairs are moved."""
    left, right = (_of(sets, pairs.select(F.col(c).alias("id")).distinct()).toDF(c, x) for c, x in (("a", "x"), ("b", "y")))
    both = pairs.join(left, "a").join(right, "b")
    return both.where(T.jaccard(F.col("x"), F.col("y")) > over).select("a", "b")


def greedy(chunks: DataFrame, group: str, order: str, text: str = "text", over: float = 0.8, n: int = 8, front: int = FRONT) -> DataFrame:
    """group, order of the chunks that stay: in each group, by the order, those whose Jaccard similarity to no chunk kept
    before is above `over`. Chunks of fewer than n words, or without a text, are all alike.

    A null group is a group of its own, and a null order comes first. Chunks of one order in a group are taken by hashes
    of their sets. Shingles are 64-bit hashes of their group and of 64-bit hashes of their words. Other columns of `chunks` are not looked at.

    Chunks with equal sets are one. Two sets that are alike share a shingle among the rarest of each (a share of 1 - over
    of them and one), so a set with so many that no other has stays, and its shingles go no further. In each round the first `front` open chunks of each such shingle are compared; one that is among
    these wherever it occurs, and is like none before it, stays. Then only those that stay are compared with what is open
    after them, and what they are like leaves all further rounds. So a group of near copies costs one
    comparison a copy for each of its chunks that stay.
    """
    spark = chunks.sparkSession
    made: list[str] = []

    def written(df: DataFrame, what: str) -> DataFrame:
        made.append(fresh(spark, what))
        df.write.parquet(made[-1])
        return spark.read.schema(df.schema).parquet(made[-1])

    hashes = F.transform(T.words(F.coalesce(F.col(text), F.lit(""))), lambda w: F.xxhash64(w))
    runs = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(F.col(group), *[F.get(h, i + k) for k in range(n)]))
    shingles = T.bound(hashes, lambda h: F.when(F.size(h) >= n, F.sort_array(F.array_distinct(runs(h)))).otherwise(F.array().cast("array<bigint>")))
    sets = chunks.select(F.col(group).alias("g"), F.col(order).alias("o"), shingles.alias("s"))
    # one shingle in `share` is looked at first: of most sets these show that their prefix is theirs alone
    share = max(1, int(0.6 / (1 - over))) if over < 1 else 1
    looked = F.size(F.filter("s", lambda w: F.pmod(w, F.lit(share)) == 0)) if share > 1 else F.size("s")
    # sets are written where they are made and only those that may have one like them are moved; numbers are drawn when the table is written
    every = written(sets.select(F.monotonically_increasing_id().alias("id"), "g", "o", F.xxhash64("s").alias("h"), F.xxhash64(F.lit(17), "s").alias("i"), F.size("s").alias("n"), looked.alias("m"), "s"), "dedup-sets")
    first = Window.partitionBy("g", "h", "i").orderBy("o", "id")
    judged = written(every.select("id", "g", "o", F.struct("o", "h", "i").alias("k"), "n", "m", F.row_number().over(first).alias("at")), "dedup-first")
    reps = judged.where("at = 1").drop("at")

    of = Window.partitionBy("w")
    some = _of(every.select("id", "s"), judged.where("at > 1").select("id"), "left_anti").select("id", F.explode("s").alias("w")).where(F.pmod("w", F.lit(share)) == 0)
    shared = some.withColumn("met", F.min("id").over(of) < F.max("id").over(of)).where("met").groupBy("id").agg(F.count("*").alias("shared"))
    prefix = F.col("n") - F.ceil(F.col("n") * over) + 1
    may = written(reps.where("n > 0").join(shared, "id", "left").where(F.col("m") - F.coalesce("shared", F.lit(0)) < prefix).select("id"), "dedup-may")
    sets = written(_of(every, may).select("id", "s"), "dedup-sets-open")

    words = sets.select("id", F.size("s").alias("n"), F.explode("s").alias("w"))
    shared = words.withColumn("df", F.count("*").over(of)).where("df > 1")
    # shingles of one chunk alone come first in it and meet nothing
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("df"), F.desc("w")))
    prefix = shared.withColumn("from_end", place).where(F.col("from_end") >= F.ceil(F.col("n") * over)).select("w", "id", "n")
    live = written(prefix.withColumn("places", F.count("*").over(Window.partitionBy("id"))).join(reps.select("id", "k"), "id").select("w", "id", "k", "n", "places"), "dedup-open")
    opened = made[-1]
    kept = [written(reps.join(live.select("id").distinct(), "id", "left_anti").select("id"), "dedup-stays")]

    def sized(a: str, b: str) -> Column:
        return F.least(a, b) >= F.greatest(a, b) * over

    while not live.isEmpty():
        before = opened
        top = live.withColumn("r", F.row_number().over(Window.partitionBy("w").orderBy("k", "id"))).where(F.col("r") <= front)
        top = written(top.select("w", "id", "k", "n", "r", "places"), "dedup-front")
        early, late = top.select("w", F.col("id").alias("a"), F.col("n").alias("na"), F.col("r").alias("ra")), top.select("w", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("r").alias("rb"))
        met = written(early.join(late, "w").where((F.col("ra") < F.col("rb")) & sized("na", "nb")).select("a", "b").distinct(), "dedup-met")
        after = _alike(met, sets, over).select(F.col("b").alias("id")).distinct()
        seen = top.groupBy("id").agg(F.count("*").alias("m"), F.first("places").alias("places")).where("m = places")
        stays = written(seen.join(after, "id", "left_anti").select("id"), "dedup-stays")
        kept.append(stays)
        rest = live.join(stays, "id", "left_anti")
        mine = live.join(stays, "id", "left_semi").select("w", F.col("id").alias("a"), F.col("k").alias("ka"), F.col("n").alias("na"))
        met = mine.join(rest.select("w", F.col("id").alias("b"), F.col("k").alias("kb"), F.col("n").alias("nb")), "w")
        met = written(met.where((F.col("ka") < F.col("kb")) & sized("na", "nb")).select("a", "b").distinct(), "dedup-met")
        gone = _alike(met, sets, over).select(F.col("b").alias("id")).distinct()
        live = written(rest.join(gone, "id", "left_anti"), "dedup-open")
        opened = made[-1]
        removed(spark, before)
        made.remove(before)
    stays = kept[0]
    for k in kept[1:]:
        stays = stays.unionByName(k)
    out = reps.select("id", F.col("g").alias(group), F.col("o").alias(order)).join(stays, "id", "left_semi").drop("id")
    out = written(out, "dedup-kept")
    for path in made[:-1]:
        removed(spark, path)
    return out
