"""Structured Streaming over arriving chunks: which of the asked terms they hold, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.containment import contains_join

SCHEMA = "chunk_id bigint, source_path string, source string, text string"


def follow_chunks(spark: SparkSession, folder: str, terms: DataFrame, target: str, state: str) -> StreamingQuery:
    """Reads parquet files of chunks as they arrive in `folder`, and keeps in `target` (a folder batch=N per
    batch) the places of the terms. A batch that is run again after a failure overwrites its own folder, so
    each chunk file counts once. Ends when all files present are treated.

    The places are what verify.claim_facts takes for hits; a claim's status follows from their union."""

    def treat(batch: DataFrame, number: int) -> None:
        contains_join(terms, batch, "chunk_id").write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    return stream.writeStream.foreachBatch(treat).option("checkpointLocation", state).trigger(availableNow=True).start()
