"""Redaction of a stream of records: pseudonyms are pure hashes, so a stream needs no state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def redact_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, redact: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Redacts Parquet files as they land in ``source`` and appends them to ``sink``; ends when all that is there is done.

    ``redact`` is any function of this library that works row by row.
    """
    schema = spark.read.parquet(source).schema
    rows = redact(spark.readStream.schema(schema).parquet(source))
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(sink)
