"""The stages that look at one record at a time, on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loam.operators.chunk import chunks
from loam.operators.messages import clean_messages
from loam.operators.quality import reason


def cleaned(stream: DataFrame) -> DataFrame:
    """messages of a stream (or table), cleaned, with the reason for which a record would go. Dedup and splits need all rows: they stay in batch."""
    rows = stream.withColumn("messages", clean_messages(F.col("messages")))
    return rows.withColumn("reason", F.when(F.size("messages") < 2, "empty_after_cleaning").otherwise(reason(F.col("messages"))))


def chunked(stream: DataFrame, text: str) -> DataFrame:
    return chunks(stream, text)


def follow(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """Read JSON files of messages as they come, clean them and add the kept ones to a Parquet folder; ends when all present files are done."""
    rows = cleaned(spark.readStream.schema(schema).json(source)).filter("reason is null")
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
