"""What several operators share: the shared folder, written tables and word handling."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define a word break: space and U+0009 to U+000D.
BREAK = r"[\x20\x09-\x0D]+"
#: Bytes of an Arrow batch of texts, and Spark's setting for it.
BATCH, _BATCH_BYTES = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Spark's setting to delete a query's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``. Where it is unset: a temporary one on a single machine, an error on a cluster."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not jvm_dir.isDefined() and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = jvm_dir.get() if jvm_dir.isDefined() else tempfile.mkdtemp(prefix="sparkweave-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts the lineage and outlives a lost executor.

    The files go when the application ends, or earlier through ``dropped``; the shuffle files of the plan go at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    fs, target = _filesystem(spark, path)
    fs.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more."""
    for table in tables:
        fs, target = _filesystem(table.sparkSession, table._written_path)
        fs.delete(target, True)


def in_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow(function, schema)``. Batches are large by default, and several copies of one are in memory at once;
    where the session leaves their size at Spark's default, it is set to ``BATCH``."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_BYTES, "64m") in ("67108864b", "64m"):
        conf.set(_BATCH_BYTES, BATCH)
    return df.mapInArrow(function, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(columns: list[str], *names: str) -> list[str]:
    """The names, with as many underscores after each as it takes that no column is called so."""
    taken, end = {c.lower() for c in columns}, ""
    while any((n + end).lower() in taken for n in names):
        end += "_"
    return [n + end for n in names]


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z only."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BREAK), lambda w: w != "")


def unsigned_hex(value: Column) -> Column:
    """A 64-bit number as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))
