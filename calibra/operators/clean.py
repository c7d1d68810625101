"""Cleaning: trim, de-duplicate, drop rows and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibra.functions.text import blank_to_null
from calibra.functions.types import is_string, require_columns


def nan_to_null(df: DataFrame) -> DataFrame:
    """One notion of missing: floating NaN becomes SQL NULL."""
    return df.select(
        *[
            F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema
        ]
    )


def normalize_strings(df: DataFrame) -> DataFrame:
    """Strip all string columns; blank text becomes NULL."""
    return df.select(
        *[
            blank_to_null(F.col(f.name)).alias(f.name) if is_string(f.dataType) else F.col(f.name)
            for f in df.schema
        ]
    )


def dedup_rows(df: DataFrame) -> DataFrame:
    """Full-row distinct, NULL equal to NULL.

    The partial aggregate removes copies on the map side, so a row with very
    many copies costs one shuffled row per task.
    """
    return df.dropDuplicates()


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    require_columns(df, [target], "target column")
    return df.filter(F.col(target).isNotNull())


def clean(df: DataFrame, target: str) -> DataFrame:
    """The fixed cleaning order: strip, de-duplicate, drop rows without target."""
    require_columns(df, [target], "target column")
    return drop_null_target(dedup_rows(normalize_strings(nan_to_null(df))), target)


def cleaning_counts(df: DataFrame, target: str) -> DataFrame:
    """One row: raw rows, rows after de-duplication, rows left after the target check."""
    return counts_from(df, dedup_rows(normalize_strings(nan_to_null(df))), target)


def counts_from(df: DataFrame, distinct: DataFrame, target: str) -> DataFrame:
    """The cleaning counts when the de-duplicated rows are at hand."""
    kept = distinct.agg(
        F.count(F.lit(1)).alias("deduplicated_rows"),
        F.count(target).alias("cleaned_rows"),
    )
    raw = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return kept.select(
        raw.alias("original_rows"),
        "deduplicated_rows",
        "cleaned_rows",
        (raw - F.col("deduplicated_rows")).alias("duplicate_rows_removed"),
        (F.col("deduplicated_rows") - F.col("cleaned_rows")).alias("target_null_rows_removed"),
    )


def denied_columns(df: DataFrame, deny_list: tuple[str, ...], target: str | None) -> list[str]:
    """Names of the deny list present in the table, in list order, never the target."""
    present = set(df.columns)
    return [c for c in deny_list if c in present and c != target]


def project_denylist(df: DataFrame, deny_list: tuple[str, ...], target: str | None) -> DataFrame:
    return df.drop(*denied_columns(df, deny_list, target))


def _constant_flag(name: str):
    # NULL counts as a value: constant means no value at all, or one value and no NULL.
    value = F.col(name)
    return (F.count(value) == 0) | (
        (F.count(value) == F.count(F.lit(1))) & F.min(value).eqNullSafe(F.max(value))
    )


def constant_columns(df: DataFrame) -> DataFrame:
    """Rows ``(column, is_constant)`` from one pass of min, max and count."""
    flags = df.agg(*[_constant_flag(c).alias(f"f{i}") for i, c in enumerate(df.columns)])
    return flags.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), F.col(f"f{i}").alias("is_constant"))
                    for i, c in enumerate(df.columns)
                ]
            )
        )
    )


def find_constant_columns(df: DataFrame) -> list[str]:
    if not df.columns:
        return []
    found = {r["column"] for r in constant_columns(df).filter("is_constant").collect()}
    return [c for c in df.columns if c in found]


def drop_constant_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    constant = find_constant_columns(df)
    return df.drop(*constant), constant
