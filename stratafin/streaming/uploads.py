"""Uploaded files as micro-batches through the batch operators.

Documents do not depend on one another, so no state is kept between batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def uploaded_files(spark: SparkSession, path: str, pattern: str = "*.pdf", per_batch: int = 100) -> DataFrame:
    """A stream of (doc_id, file_name, content)."""
    df = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).load(path)
    return df.select(F.col("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")


def analyze_uploads(files: DataFrame, analyze: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes ``analyze`` of every micro-batch to ``out``, one folder a batch, so a repeated batch replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        analyze(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
