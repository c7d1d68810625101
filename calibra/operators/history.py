"""Append-only prediction history."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = "criado_dia"
LIMIT = 50


def history_rows(scored: DataFrame, user: str) -> DataFrame:
    """Response rows with id, user, time and day."""
    return scored.select(
        F.expr("uuid()").alias("id"),
        *scored.columns,
        F.lit(user).alias("usuario_id"),
        F.current_timestamp().alias("criado_em"),
    ).withColumn(DAY, F.to_date("criado_em"))


def append_history(scored: DataFrame, path: str, user: str, replace: bool = False) -> None:
    """Add rows; earlier rows are never overwritten. Files are sorted by record
    number inside each day, so min/max statistics skip row groups in queries.

    ``replace`` is for a folder that belongs to one streaming batch alone: a
    retry of the batch then takes the place of its first try.
    """
    rows = history_rows(scored, user).sortWithinPartitions("numero_laudo", "criado_em")
    rows.write.mode("overwrite" if replace else "append").partitionBy(DAY).parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def query_history(
    history: DataFrame, number: str, start: datetime | None = None, end: datetime | None = None, limit: int = LIMIT,
) -> DataFrame:
    """Rows of one record number, newest first, within an inclusive time range."""
    out = history.filter(F.col("numero_laudo") == F.lit(number))
    if start is not None:
        out = out.filter(F.col("criado_em") >= F.lit(start))
        if DAY in history.columns:
            out = out.filter(F.col(DAY) >= F.to_date(F.lit(start)))
    if end is not None:
        out = out.filter(F.col("criado_em") <= F.lit(end))
        if DAY in history.columns:
            out = out.filter(F.col(DAY) <= F.to_date(F.lit(end)))
    return out.orderBy(F.desc("criado_em"), "id").limit(limit)
