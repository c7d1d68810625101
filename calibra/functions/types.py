"""Column groups by type, read from the schema alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def is_string(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, DATETIME_TYPES)


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema if is_string(f.dataType) and f.name not in exclude]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_datetime(f.dataType)]


def type_groups(df: DataFrame) -> dict[str, list[str]]:
    groups: dict[str, list[str]] = {}
    for field in df.schema:
        groups.setdefault(field.dataType.simpleString(), []).append(field.name)
    return groups


def field_type_name(dtype: T.DataType) -> str:
    """Simple contract type of a column: bool, int, float or str."""
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.IntegralType):
        return "int"
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return "float"
    return "str"


def require_columns(df: DataFrame, columns: list[str] | tuple[str, ...], what: str = "columns") -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing {what}: {', '.join(missing)}")
