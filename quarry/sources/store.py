"""Folders that driver and executors share, chunk files, and settings."""

from __future__ import annotations

import dataclasses
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T

CHUNK = "id string, sha256 string, text string, source_name string, page_start int, page_end int, tokens int, parser string, char_start int, char_end int, section_path string, md_types_present array<string>, header_level int, sentence_count int, metadata map<string,string>"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where that is unset on a local master."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="quarry-store-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def fresh(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/quarry-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Written to the shared folder and read back, so that it is worked out once and lineage ends there."""
    path = fresh(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _files(spark, path)
    return fs.exists(at)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table in between that nothing reads any more."""
    fs, at = _files(spark, path)
    fs.delete(at, True)


MARK = "_quarry_store"


def claim(spark: SparkSession, path: str) -> None:
    """Makes a folder a store; only such folders are ever deleted."""
    fs, at = _files(spark, path)
    fs.mkdirs(at)
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at, MARK)
    if not fs.exists(mark):
        fs.create(mark).close()


def reset(spark: SparkSession, path: str) -> None:
    """Deletes what a store holds. Any other folder is refused."""
    fs, at = _files(spark, path)
    if not fs.exists(at):
        return
    if not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at, MARK)):
        raise ValueError(f"{path} is not a store")
    fs.delete(at, True)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """One JSON object a chunk, added to what is there."""
    chunks.write.mode("append").json(path)


def read_chunks(spark: SparkSession, path: str, schema: str = CHUNK) -> DataFrame:
    """Chunks of JSON lines, blank lines left out; an id that is missing is worked out."""
    rows = spark.read.schema(schema).json(path)
    own = T.chunk_id(*[F.col(c) for c in ("text", "source_name", "page_start", "page_end", "char_start", "char_end")])
    return rows.where(F.col("text").isNotNull()).withColumn("id", F.coalesce("id", own))


def exported(chunks: DataFrame) -> DataFrame:
    """value: one JSON object of id, text and metadata a chunk."""
    return chunks.select(F.to_json(F.struct("id", "text", "metadata")).alias("value"))


def put_json(spark: SparkSession, path: str, value: dict) -> None:
    fs, at = _files(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    out.close()


def get_json(spark: SparkSession, path: str) -> dict:
    fs, at = _files(spark, path)
    stream = fs.open(at)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


@dataclasses.dataclass(frozen=True)
class Options:
    """What a user can set, with its defaults."""

    strategy: str = "token"
    target_tokens: int = 700
    overlap_tokens: int = 80
    min_tokens: int = 120
    char_size: int = 4000
    char_overlap: int = 400
    semantic_threshold: float = 0.65
    mode: str = "hybrid"
    top_k: int = 8
    rerank_top_n: int = 15
    rrf_k: int = 60
    alpha: float = 0.7
    reranker: str = "none"
    sparse_backend: str = "BM25"
    top_k_vocab: int = 60
    answer_mode: str = "extractive"
    company: str = "the company"
    include_front_matter: bool = False
    front_matter_keys: tuple[str, ...] = ("source_name", "section_path", "page_start", "page_end", "tokens", "sha256", "created_at")

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), sort_keys=True)

    def merged(self, text: str) -> Options:
        """These options with those of a JSON text over them; names that are none are left out."""
        given = json.loads(text)
        given = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items()}
        return dataclasses.replace(self, **{f.name: given[f.name] for f in dataclasses.fields(self) if f.name in given})
