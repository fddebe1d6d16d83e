"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Quality rules and toxicity drop documents, line dedup rewrites texts, the n-gram Jaccard join keeps
one document of each group (five words, similarity 0.8), and packing returns each document's bucket,
bound and batch. Every stage takes all that its predecessor kept. A stage of no rows gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import jaccard, lines, packing, quality, toxicity
from quarry.llm.queries import token_lengths, toxic_model
from quarry.llm.shared import dropped, fresh

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.score(docs.select(*COLUMNS), toxic_model(spark, docs, sf_dir), keep_text=True)
    return scored.where("predicted = 0").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the stage before has emptied carry nothing on and go as well."""
    return jaccard.first_of_each(docs.select(*COLUMNS), k=5, num=80, den=100)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(token_lengths(docs, "n_tokens"), "n_tokens")


STAGES = [("quality_rules", quality_rules), ("toxicity", toxic), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_jaccard), ("packing", packing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = fresh(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            dropped(spark, before)
        before = docs
    return docs
