"""Chunk identities, distinct chunks, incremental ingest and corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """content, first, n: texts that are equal after normalisation."""
    return docs.groupBy(T.content_hash(F.col(text)).alias("content")).agg(F.min(key).alias("first"), F.count("*").alias("n"))


def ingest(new: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """Chunks whose id is not stored yet; repeats inside the batch survive. Of the stored rows only ids are read, and only those
    that the batch has too go on, so the store is not shuffled where the batch's ids are few."""
    ids = new.select(key).distinct()
    known = stored.select(key).join(ids, key, "left_semi").distinct()
    return new.join(known, key, "left_anti")


def corpus_stats(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    tokens = F.coalesce(T.approx_tokens(F.col(text)), F.lit(0)).cast("long")
    return docs.agg(
        F.count("*").alias("chunks"),
        F.countDistinct(F.coalesce(source, F.lit("Unknown"))).alias("sources"),
        F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"),
        F.round(F.coalesce(F.avg(tokens), F.lit(0.0)), 6).alias("mean_tokens"),
    )


def ingest_stats(found: DataFrame, new: DataFrame, source: str = "source_name") -> dict[str, int]:
    """files, new and skipped of a batch of chunks of which `new` is stored."""
    every = found.agg(F.countDistinct(source).alias("files"), F.count("*").alias("n")).first()
    stored = new.count()
    return {"files": every.files, "new": stored, "skipped": every.n - stored}


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """As corpus_stats, of stored chunks with their token counts."""
    tokens = F.coalesce("tokens", F.lit(0))
    return chunks.agg(F.count("*").alias("chunks"), F.countDistinct(F.coalesce("source_name", F.lit("Unknown"))).alias("sources"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"), F.round(F.coalesce(F.avg(tokens), F.lit(0.0)), 6).alias("mean_tokens"))


def union_all(*parts: DataFrame) -> DataFrame:
    """The chunks of all parts, in one table."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
