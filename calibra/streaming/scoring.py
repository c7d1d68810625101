"""Scoring of a record stream into the append-only history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from calibra.operators.history import append_history
from calibra.operators.score import response
from calibra.plans.scoring import Scorer


def read_record_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; ``pattern`` limits the file names."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def stream_to_history(
    records: DataFrame, scorer: Scorer, history: str, checkpoint: str, user: str, key: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Score each micro-batch with the batch function and append the responses.

    Scoring is stateless, so no watermark is needed. ``history`` is a folder of
    this stream alone: a batch that is retried after a failure is written again
    under the same batch folder, which keeps one copy of it.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        append_history(response(scorer.score(batch, key)), f"{history}/batch={batch_id}", user, replace=True)

    return (
        records.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
