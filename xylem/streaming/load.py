"""Streaming loads: every micro-batch of documents is merged; merging by hash makes a repeated batch harmless."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from xylem.api import DataModel


def read_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """xml of new files in a folder."""
    source = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch)
    return source.load(folder).select(F.col("value").alias("xml"))


def load_stream(model: DataModel, texts: DataFrame, checkpoint: str, metadata: dict | None = None) -> StreamingQuery:
    """Merge a stream with a column xml into the model's store; processes what is there and stops."""

    def load(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            model.parse_xml(batch, metadata).insert_into_target_tables()

    return texts.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
