"""Importance resampling towards a target distribution, by hashed n-grams (operator 11).

Features of a text are its runs of one to `grams` consecutive words (ASCII letters and digits, and all characters beyond
ASCII; A-Z lower-cased), repeats counted. Each task has a DuckDB of its own, bounded in memory, which takes blocks of texts:
SQL unnests the words, windows make the runs, a registered function gives zlib's CRC of each, and SQL counts the buckets of each text.
Counts a text, and sums a task, are spilled as one Parquet table in the shared folder. Spark merges the sums of corpus and
target to a gain a bucket, scores the spilled counts, and draws: rows are dealt by ranges of their score, the ranges are
counted, and ranks run on from range to range, so no task holds more than its range and the driver one number a range.

Edge cases: null and empty texts and texts without words have no features and weight 0; a null id is hashed as an
empty string and comes last among equal scores; repeated rows are rows of their own, ranked next to each other; bytes that are no UTF-8 count
as U+FFFD; a word or text of any length is taken whole (texts are handed over in pieces cut between words); an empty target gives each
bucket its share of an even spread; empty tables give no rows; further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.shared import dropped, stored

BUCKETS = 10_000
#: Bytes of text that a block has at most, unless one text has more, and of a piece of a text.
BLOCK, PIECE = 1 << 20, 1 << 16
_APART = "".join(chr(c) for c in range(128) if not chr(c).isdigit() and not "a" <= chr(c) <= "z")
_FOLDED = "".join(c.lower() if "A" <= c <= "Z" else " " for c in _APART)
_BLANK = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def _crc(features: pa.Array) -> pa.Array:
    """zlib's CRC-32 of each string of an Arrow column."""
    out = []
    for part in features.chunks if isinstance(features, pa.ChunkedArray) else [features]:
        part = part.cast(pa.large_string())
        offsets = np.frombuffer(part.buffers()[1], np.int64, len(part) + 1, part.offset * 8).tolist()
        data = memoryview(part.buffers()[2] or b"")
        out += [zlib.crc32(data[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]
    return pa.array(out, pa.uint32())


def _sql(grams: int, buckets: int) -> str:
    """One pass over the pieces of a block, in order and in one thread, so that the windows stream."""
    ahead = [f"CASE WHEN lead(row, {i}) OVER () = row THEN lead(word, {i}) OVER () END AS w{i}" for i in range(1, grams)]
    runs = ["word", *(f"word || ' ' || {" || ' ' || ".join(f'w{j}' for j in range(1, i + 1))}" for i in range(1, grams))]
    return f"""WITH words AS (SELECT row, word FROM (SELECT row, unnest(string_split(translate(piece, (SELECT apart FROM fold), (SELECT folded FROM fold)), ' ')) AS word FROM pieces) WHERE word <> ''),
 windows AS (SELECT {", ".join(["row", "word", *ahead])} FROM words),
 features AS (SELECT row, unnest([{", ".join(runs)}]) AS feature FROM windows),
 counts AS (SELECT row, (zlib_crc32(feature) % {buckets})::INT AS bucket, count(*) AS n FROM features WHERE feature IS NOT NULL GROUP BY ALL)
 SELECT row, list(bucket ORDER BY bucket) AS buckets, list(n ORDER BY bucket) AS ns FROM counts GROUP BY row ORDER BY row"""


def _pieces(text: str) -> list[str]:
    out, lo = [], 0
    while len(text) - lo > PIECE and (cut := _BLANK.search(text, lo + PIECE)):
        out.append(text[lo : cut.end()])
        lo = cut.end()
    return [*out, text[lo:]]


def counted(docs: DataFrame, grams: int = 3, buckets: int = BUCKETS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_features, buckets, ns of each row, and a row a task with `total` true and the sums of its rows, stored."""
    rows = docs.select(F.col(key).alias("key"), F.make_valid_utf8(F.coalesce(text, F.lit(""))).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    sql = _sql(grams, buckets)

    def spill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})
        con.create_function("zlib_crc32", _crc, ["VARCHAR"], "UINTEGER", type="arrow")
        con.execute("CREATE TABLE fold AS SELECT ?::VARCHAR AS apart, ?::VARCHAR AS folded", [_APART, _FOLDED])
        total = np.zeros(buckets, np.int64)

        def block(keys: pa.Array, texts: list[str]) -> pa.RecordBatch:
            cut = [(i, p) for i, t in enumerate(texts) for p in (_pieces(t) if len(t) > PIECE else (t,))]
            con.register("pieces", pa.table({"row": pa.array([i for i, _ in cut], pa.int32()), "piece": pa.array([p for _, p in cut], pa.string())}))
            found = con.sql(sql).to_arrow_table().combine_chunks()
            con.unregister("pieces")
            sizes, features = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            flat, ns = np.empty(0, np.int64), np.empty(0, np.int64)
            if found.num_rows:
                at, lists = found["row"].to_numpy(), found["buckets"].combine_chunks()
                flat, ns = lists.flatten().to_numpy(), found["ns"].combine_chunks().flatten().to_numpy()
                sizes[at] = lists.value_lengths().to_numpy()
                features = np.bincount(np.repeat(np.arange(len(texts)), sizes), ns, len(texts)).astype(np.int64)
                np.add.at(total, flat, ns)
            starts = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            return batch_of(keys, features, pa.ListArray.from_arrays(starts, pa.array(flat, pa.int32())), pa.ListArray.from_arrays(starts, pa.array(ns, pa.int64())), False)

        def batch_of(keys, features, where, ns, is_total: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"key": keys, "n_features": pa.array(features, pa.int64()), "buckets": where, "ns": ns, "total": pa.array([is_total] * len(keys))})

        key_type = None
        for batch in batches:
            keys, texts = batch.column("key"), batch.column("text")
            key_type = keys.type
            lo, size = 0, 0
            for i, n in enumerate(pa.compute.binary_length(texts).to_pylist()):
                if size and size + n > BLOCK:
                    yield block(keys.slice(lo, i - lo), texts.slice(lo, i - lo).to_pylist())
                    lo, size = i, 0
                size += n
            if lo < len(keys):
                yield block(keys.slice(lo), texts.slice(lo).to_pylist())
        con.close()
        if key_type is not None:
            used = np.flatnonzero(total)
            yield batch_of(pa.nulls(1, key_type), [int(total.sum())], pa.array([used.tolist()], pa.list_(pa.int32())), pa.array([total[used].tolist()], pa.list_(pa.int64())), True)

    return stored(rows.mapInArrow(spill, f"key {kind}, n_features long, buckets array<int>, ns array<long>, total boolean"), "buckets")


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: the gain of each bucket, floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), from spilled sums."""
    own = [c.where("total").select(F.explode(F.arrays_zip("buckets", "ns")).alias("x")).groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.ns").alias(n)) for c, n in ((corpus, "s"), (target, "t"))]
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    sums = every.join(own[0], "bucket", "left").join(own[1], "bucket", "left").fillna(0, ["s", "t"]).select("bucket", *[F.col(c).cast("double").alias(c) for c in "st"])
    all_s, all_t = (F.sum(c).over(Window.partitionBy()) for c in "st")  # of as many rows as there are buckets
    gain = F.floor(1000 * F.log((F.col("t") + 1) * (all_s + buckets) / ((F.col("s") + 1) * (all_t + buckets))))
    listed = sums.select("bucket", gain.alias("gain")).groupBy().agg(F.array_sort(F.collect_list(F.struct("bucket", "gain"))).alias("g"))
    return listed.select(F.col("g.gain").alias("gains"))


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (5, 100), least_words: int = 20, seed: int = 42, grams: int = 3, buckets: int = BUCKETS, key: str = "doc_id", text: str = "text", target_key: str = "item_id") -> DataFrame:
    """key, n_features, weight, score, rank of every row; rank is null where the row is not drawn.

    Of the n rows with at least `least_words` words share[0] * n // share[1] are drawn, those of the highest weight plus Gumbel noise, which is a
    draw without replacement in proportion to exp(weight / 1000). The noise depends on the seed and the key alone.
    """
    spark = docs.sparkSession
    corpus, wanted = counted(docs, grams, buckets, key, text), counted(target, grams, buckets, target_key, text)
    gained = stored(gains(corpus, wanted, buckets), "gains")
    rows = corpus.where("not total").join(F.broadcast(gained))  # one row of `buckets` numbers
    weight = F.aggregate(F.zip_with("buckets", "ns", lambda b, n: F.get("gains", b) * n), F.lit(0).cast("long"), lambda a, x: a + x)
    # words follow from the features: w words have w + (w - 1) + ... of them
    full = grams * (grams - 1) // 2
    words = F.col("n_features")
    for w in range(2, grams):
        words = F.when(F.col("n_features") >= sum(w - i for i in range(w)), w).otherwise(words)
    words = F.when(F.col("n_features") + full >= grams * grams, ((F.col("n_features") + full) / grams).cast("long")).otherwise(words)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = rows.select("key", "n_features", words.alias("words"), weight.alias("weight")).withColumn("score", F.col("weight") + noise)
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    dropped(spark, corpus, wanted)

    order = [F.desc("score"), F.asc_nulls_last("key"), F.asc("row")]
    dealt = scored.where(F.col("words") >= least_words).repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    dealt = stored(dealt, "score-ranges")
    sizes = dealt.groupBy("part").count().orderBy("part").collect()  # a row a range
    most, before, starts = share[0] * sum(r["count"] for r in sizes) // share[1], 0, []
    for r in sizes:
        if before < most:
            starts.append((r.part, before))
        before += r["count"]
    last = starts[-1][0] if starts else -1
    first = F.broadcast(spark.createDataFrame(starts, "part int, start long"))
    number = F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    drawn = dealt.where(F.col("part") <= last).join(first, "part").withColumn("rank", number).withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    rest = dealt.where(F.col("part") > last).unionByName(scored.where(F.col("words") < least_words), allowMissingColumns=True).withColumn("rank", F.lit(None).cast("long"))
    out = [F.col("key").alias(key), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank")]
    return drawn.select(*out).unionByName(rest.select(*out))
