"""Listings table fed by files as they arrive.

The upload path has no state beyond which files were read, so the same column
expressions run on a stream. The file source and the checkpoint make every uploaded file
count exactly once, also after a restart.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from rentlens.plans.ingest import standard_rows


def ingest_uploads(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    table: str,
    checkpoint: str,
    source: str = "kaggle",
    sep: str = ",",
) -> StreamingQuery:
    """Append every file not seen yet and stop; call again for later uploads."""
    raw = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("sep", sep)
        .option("escape", '"')
        .csv(folder)
    )
    return (
        standard_rows(raw, source)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(table)
    )
