"""Reading tables and CSV batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.operators.clean import nan_to_null
from calibra.operators.ordering import sums_before
from calibra.session import materialize, small_side

LINE = "numero_linha"
SLICE_BLOCKS = 50_000  # file blocks that are summed up together


def resolve_path(path: str | None, default: str, fallback: str | None = None, exists=None) -> str:
    """Explicit path, else the default, else the fallback when only that exists."""
    if path is not None:
        return path
    if exists is None or fallback is None or exists(default):
        return default
    return fallback if exists(fallback) else default


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, CSV or JSON by suffix (Parquet otherwise); NaN becomes NULL."""
    if path.endswith((".csv", ".csv.gz")):
        df = spark.read.option("header", True).csv(path)
    elif path.endswith((".json", ".jsonl")):
        df = spark.read.json(path)
    else:
        df = spark.read.parquet(path)
    return nan_to_null(df)


def load_prepared(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv_batch(spark: SparkSession, path: str, line_breaks: bool = False, slice_blocks: int = SLICE_BLOCKS) -> DataFrame:
    """A UTF-8 CSV (one file or a folder of parts) as text cells with line numbers.

    The byte-order mark is dropped, empty cells are NULL, a batch without rows
    is an error. Lines count from 1 in path and file order. Numbering needs no
    global sort: a row's place inside its file block comes from its id, and the
    block's first line from the counts of the blocks before it: a two-level
    prefix sum whose slices hold about ``slice_blocks`` blocks. ``line_breaks``
    allows line breaks inside quoted cells; such files are read unsplit.
    """
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("emptyValue", "")
    raw = reader.option("escape", '"').option("multiLine", line_breaks).csv(path)
    names = {c: c.lstrip("﻿") for c in raw.columns}
    rows = raw.select(
        *[F.nullif(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in names.items()],
        F.col("_metadata.file_path").alias("__path"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__id"),
    )
    # One row per file block, counted before it is broadcast.
    blocks = materialize(
        rows.groupBy("__path", "__block").agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("first")), "blocks"
    )
    number = blocks.count()
    if number == 0:
        raise ValueError(f"the CSV batch {path} has no data rows")
    placed = sums_before(blocks, ["__path", "__block"], "n", "before", -(-number // slice_blocks))
    starts = placed.select(F.col("__path").alias("__p"), F.col("__block").alias("__b"), "first", "before")
    joined = rows.join(
        small_side(starts, number), (F.col("__path") == F.col("__p")) & (F.col("__block") == F.col("__b"))
    )
    return joined.select(
        (F.col("before") + F.col("__id") - F.col("first") + 1).alias(LINE), *names.values()
    )
