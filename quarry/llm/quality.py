"""Quality rules with thresholds that adapt to language and source (operator 8).

Four measures of each document, in thousandths, are sketched by (lang, source): symbols a word,
characters a word, share of repeated lines, share of words in repeated three-word windows. The
sketch is a quantile sketch of counts in bins of constant relative width, 64 to a doubling, without an upper
end: an associative sum, so it merges in any order, gives the same thresholds in any partitioning, and
has quantiles within 1/64; a group has at most some hundred bins a measure. A measure fails beyond the fence
q75 + 3 (q75 - q25) + slack (characters a word also below q25 - 3 (q75 - q25) - slack), all read as the
lower ends of their bins. Sketches of fewer than `least` documents are merged into that of their
language, and those of small languages into that of all documents. Documents that fail the base
rules (fewer than 50 words, or over half of the words in repeated windows) are rejected whatever the
thresholds, and stay out of the sketches.

Edge cases: a null or empty text has no word and fails the base rule; null lang and null source are
groups of their own; repeated rows are judged each; empty tables give empty results; columns with
the names of the counts, of base_failed or of kept are replaced, all others are kept whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import vec
from quarry.llm.shared import free, stored

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Measure: numerator, denominator, slack in thousandths, whether low values fail too.
RULES = {
    "symbols": ("n_symbols", "n_words", 250, False),
    "word_length": ("word_chars", "n_words", 1000, True),
    "dup_lines": ("n_dup_lines", "n_lines", 400, False),
    "repeats": ("n_repeat_words", "n_words", 300, False),
}
LEAST, SPREAD, BITS = 100, 3, 7
MIN_WORDS = 50
#: Thresholds of up to so many groups (a few MB) are broadcast; more are joined by shuffle.
BROADCAST_GROUPS = 20_000


def counts(block: vec.Texts) -> dict[str, np.ndarray]:
    starts, ends, first = block.words()
    hashes = block.hashes(starts, ends)
    inside = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum(vec.LEADING[block.data] & ~vec.SPACE[block.data], out=inside[1:])
    out = {"n_words": np.diff(first), "word_chars": inside[block.offsets[1:]] - inside[block.offsets[:-1]], "n_symbols": block.per_doc(vec.SYMBOL[block.data])}

    ls, le, lfirst = block.lines()
    docs = np.repeat(np.arange(block.n), np.diff(lfirst))
    filled = inside[le] > inside[ls]
    lines = vec.keyed(block.hashes(ls[filled], le[filled]), docs[filled])
    _, at = np.unique(lines, return_index=True)
    n_lines = np.bincount(docs[filled], minlength=block.n)
    out |= {"n_dup_lines": n_lines - np.bincount(docs[filled][at], minlength=block.n), "n_lines": n_lines}

    word_docs = np.repeat(np.arange(block.n), np.diff(first))
    found, at = vec.windows(hashes, first, 3)
    covered = np.zeros(len(hashes) + 3, bool)
    if len(found):
        _, inverse, times = np.unique(vec.keyed(found, word_docs[at]), return_inverse=True, return_counts=True)
        again = at[times[inverse] > 1]
        for i in range(3):
            covered[again + i] = True
    out["n_repeat_words"] = np.bincount(word_docs[covered[: len(hashes)]], minlength=block.n)
    return {k: out[k].astype(np.int64) for k in COUNTS}


def measure(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds the counts and base_failed."""
    kept = [f for f in df.schema.fields if f.name not in COUNTS and (keep_text or f.name != text)]
    schema = T.StructType(kept + [T.StructField(n, T.LongType()) for n in COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in vec.texts(batch.column(text)):
                rows = batch.slice(block.first, block.n)
                found = {n: rows.column(n) for n in (f.name for f in kept)}
                yield pa.RecordBatch.from_pydict(found | {k: pa.array(v) for k, v in counts(block).items()})

    out = df.mapInArrow(run, schema)
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def binned(m: str) -> Column:
    """A measure in thousandths as the lower end of its bin; null without a word."""
    n, d = RULES[m][:2]
    value = F.when(F.col(d) > 0, F.expr(f"({n} * 1000) div {d}"))
    shift = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(measures: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """g_lang, g_source, measure, value, n: counts of the values of each group's documents."""
    long = F.stack(F.lit(len(RULES)), *[x for m in RULES for x in (F.lit(m), binned(m))]).alias("measure", "value")
    return measures.where(~F.col("base_failed")).select(F.col(lang).alias("g_lang"), F.col(source).alias("g_source"), long).groupBy("g_lang", "g_source", "measure", "value").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, n_docs, low, high from sketches that are merged by the keys."""
    merged = sketch.groupBy(*keys, "measure", "value").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    ranked = merged.withColumns({"upto": F.sum("n").over(group.orderBy("value")), "n_docs": F.sum("n").over(group)})
    quantile = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("n_docs"), F.col("value")))
    q = ranked.groupBy(*keys, "measure", "n_docs").agg(quantile(1).alias("q25"), quantile(3).alias("q75"))
    slack = F.create_map(*[F.lit(x) for m, r in RULES.items() for x in (m, r[2])])[F.col("measure")]
    two = F.col("measure").isin([m for m, r in RULES.items() if r[3]])
    spread = SPREAD * (F.col("q75") - F.col("q25")) + slack
    return q.select(*keys, "measure", "n_docs", F.when(two, F.col("q25") - spread).otherwise(-1).alias("low"), (F.col("q75") + spread).alias("high"))


def thresholds(sketch: DataFrame, least: int = LEAST) -> DataFrame:
    """g_lang, g_source and low_/high_ of each measure: the finest sketch with `least` documents."""
    wide = lambda f, keys, p: f.groupBy(*keys).agg(F.max("n_docs").alias(f"{p}_n"), *[F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{p}_{c}_{m}") for m in RULES for c in ("low", "high")])
    fine = wide(fences(sketch, ["g_lang", "g_source"]), ["g_lang", "g_source"], "fine")
    by_lang = wide(fences(sketch, ["g_lang"]), ["g_lang"], "lang").withColumnRenamed("g_lang", "l_lang")
    whole = wide(fences(sketch.withColumn("one", F.lit(1)), ["one"]), ["one"], "all").drop("one")
    joined = fine.join(by_lang, F.col("g_lang").eqNullSafe(F.col("l_lang"))).crossJoin(F.broadcast(whole))  # the last has one row
    pick = lambda c, m: F.when(F.col("fine_n") >= least, F.col(f"fine_{c}_{m}")).when(F.col("lang_n") >= least, F.col(f"lang_{c}_{m}")).otherwise(F.col(f"all_{c}_{m}")).alias(f"{c}_{m}")
    return joined.select("g_lang", "g_source", *[pick(c, m) for m in RULES for c in ("low", "high")])


def judged(measures: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Adds kept. limits is broadcast only if it has at most BROADCAST_GROUPS rows."""
    spark, spelled = measures.sparkSession, limits.columns
    rows = limits.limit(BROADCAST_GROUPS + 1).collect()
    if len(rows) <= BROADCAST_GROUPS:
        limits = F.broadcast(spark.createDataFrame(rows, limits.schema))
    columns = [c for c in measures.columns if c != "kept"]
    groups = free(columns, *limits.columns)
    limits = limits.toDF(*groups)
    at = dict(zip(spelled, groups, strict=True))
    joined = measures.join(limits, F.col(lang).eqNullSafe(F.col(at["g_lang"])) & F.col(source).eqNullSafe(F.col(at["g_source"])), "left")
    fine = F.lit(True)
    for m in RULES:
        fine = fine & F.coalesce(binned(m).between(F.col(at[f"low_{m}"]), F.col(at[f"high_{m}"])), F.lit(True))
    return joined.select(*columns, (~F.col("base_failed") & fine).alias("kept"))


def quality(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, keep_text: bool = True) -> DataFrame:
    """All columns (without the text, if so asked), the counts, base_failed and kept.

    The texts are measured twice where they are kept, once for the sketches and once for the
    verdict, so that no text is shuffled.
    """
    narrow = df.select(*dict.fromkeys(c for c in ([text, lang, source] if keep_text else df.columns)))
    measures = measure(narrow, text, keep_text=False)
    if keep_text:
        return judged(measure(df, text), thresholds(sketches(measures, lang, source), least), lang, source)
    measures = stored(measures, "measures")
    return judged(measures, thresholds(sketches(measures, lang, source), least), lang, source)
