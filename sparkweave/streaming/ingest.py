"""Sections that arrive as Parquet files become chunks in an append-only table, exactly once for each file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkweave.functions import text as T
from sparkweave.operators.chunk import sections_to_chunks

SECTIONS = "doc_id string, filepath string, section_no int, heading_path string, text string, metadata map<string,string>"


def stream_chunks(spark: SparkSession, source: str, sink: str, checkpoint: str, min_chars: int = 200) -> StreamingQuery:
    """Starts a query that handles all files there are and then stops; a second start goes on where the first ended."""

    def write(batch: DataFrame, epoch: int) -> None:
        # One file for each epoch: a repeated epoch replaces its own output.
        chunks = sections_to_chunks(batch).where(T.is_substantial(F.col("content"), min_chars))
        chunks.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    stream = spark.readStream.schema(SECTIONS).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
