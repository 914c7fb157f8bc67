"""Tables between the steps of an operator: written to the folder that all executors share, so that lineage is cut and a lost executor costs nothing."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    """From ``spark.checkpoint.dir``; where it is unset a temporary folder on a single machine, an error on a cluster."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not folder and known.isDefined():
        folder = known.get()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="sparkweave-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table that goes when the application ends."""
    spark = df.sparkSession
    path = f"{_shared(spark)}/steps/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch as Python sees it; as Python objects it takes many times that.
BATCH = 4 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small(batch: pa.RecordBatch):
    """The batch in parts of at most ``BATCH`` bytes, or of one row."""
    if batch.nbytes <= BATCH or batch.num_rows < 2:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from small(batch.slice(0, half))
        yield from small(batch.slice(half))


def in_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow(function, schema)`` over small batches, so that a task's memory does not grow with its rows. Where the session leaves the size
    of batches at Spark's default, it is set to ``BATCH``."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_BYTES, "64m") in ("67108864b", "64m"):
        conf.set(_BATCH_BYTES, str(BATCH))

    def run(batches):
        return function(part for batch in batches for part in small(batch))

    return df.mapInArrow(run, schema)
