"""Places and small helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset and all work is done in this process (a local master), as in tests, a temporary
    folder is set. On a cluster a missing setting is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    set_to = spark.sparkContext.getCheckpointDir()
    if not where and not set_to:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="quarry-shared-")
    if not set_to:
        spark.sparkContext.setCheckpointDir(where)
    return where or set_to


def free(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores as make it differ from all that are taken."""
    lower, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in lower:
            name += "_"
        out.append(name)
    return out


def fresh(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/quarry-{what}-{uuid.uuid4().hex}"


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stored(df: DataFrame, what: str) -> DataFrame:
    """Written to the shared folder and read back: lineage is cut, and lost executors cost nothing."""
    path = fresh(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def dropped(spark: SparkSession, *frames: DataFrame) -> None:
    """Removes what stored() wrote, once nothing reads it any more. Of frames that stored() did not return, files are listed."""
    jvm = spark.sparkContext._jvm
    for path in {p for df in frames for p in ([_PATHS[df]] if df in _PATHS else {f.rpartition("/")[0] for f in df.inputFiles()})}:
        if "/quarry-" in path:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def text_hash(column: str):
    """128 bits of a string as two longs."""
    return F.xxhash64(column), F.xxhash64(F.lit(17), F.col(column))
