"""Validation of text records against a fixed contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns accepted for each contract type; all others are parsing errors.
INT_PATTERN = r"^\s*[+-]?[0-9]+(\.0*)?\s*$"
FLOAT_PATTERN = r"^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?(nan|inf|infinity))\s*$"
BOOL_PATTERN = r"^(1|0|true|false|t|f|yes|no|y|n|on|off)$"
TRUE_WORDS = ("1", "true", "t", "yes", "y", "on")

_ERRORS = "array<struct<field:string,reason:string>>"


class ContractError(ValueError):
    """A batch with invalid rows; ``errors`` lists them all."""

    def __init__(self, errors: DataFrame):
        super().__init__("the batch has invalid rows")
        self.errors = errors


def _kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.IntegralType):
        return "int"
    return "float" if isinstance(dtype, T.FractionalType) else "string"


def _number_text(text: Column) -> Column:
    return F.lower(F.trim(text))


def cast_field(text: Column, dtype: T.DataType) -> Column:
    """Typed value of a text cell, NULL when it does not parse."""
    kind = _kind(dtype)
    if kind == "int":
        whole = F.regexp_replace(F.trim(text), r"\.0*$", "")
        return F.when(text.rlike(INT_PATTERN), whole.try_cast(dtype))
    if kind == "float":
        return F.when(F.lower(text).rlike(FLOAT_PATTERN), _number_text(text).try_cast(dtype))
    if kind == "bool":
        word = F.lower(text)
        return F.when(word.rlike(BOOL_PATTERN), word.isin(*TRUE_WORDS))
    return text


def _field_error(field: T.StructField, present: bool) -> Column:
    kind = _kind(field.dataType)
    if not present:
        return F.lit("missing") if not field.nullable else F.lit(None).cast("string")
    text = F.col(field.name)
    required = F.lit(None) if field.nullable else F.lit(f"{kind}_type")
    if kind == "string":
        return F.when(text.isNull(), required)
    return F.when(text.isNull(), required).when(cast_field(text, field.dataType).isNull(), F.lit(f"{kind}_parsing"))


def row_errors(columns: list[str], contract: T.StructType, extra: tuple[str, ...] = ()) -> Column:
    """Array of ``(field, reason)`` of one text row, empty when it is valid."""
    known = set(contract.fieldNames())
    checks = [
        F.struct(F.lit(f.name).alias("field"), _field_error(f, f.name in columns).cast("string").alias("reason"))
        for f in contract
    ]
    checks += [
        F.struct(F.lit(c).alias("field"), F.lit("extra_forbidden").alias("reason"))
        for c in columns
        if c not in known and c not in extra
    ]
    return F.filter(F.array(*checks).cast(_ERRORS), lambda e: e["reason"].isNotNull())


def validate_rows(
    df: DataFrame, contract: T.StructType, line: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Split text rows into typed valid rows and one error row per bad field.

    ``line`` names a column that is kept beside the record (a line number).
    """
    keep = [line] if line else []
    checked = df.withColumn("__errors", row_errors(df.columns, contract, tuple(keep)))
    typed = [
        (cast_field(F.col(f.name), f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in contract
    ]
    valid = checked.filter(F.size("__errors") == 0).select(*keep, *typed)
    errors = checked.filter(F.size("__errors") > 0).select(*keep, F.inline("__errors"))
    return valid, errors


def validate_batch(df: DataFrame, contract: T.StructType, line: str | None = None) -> DataFrame:
    """All or nothing: typed rows, or an error that carries every bad field."""
    valid, errors = validate_rows(df, contract, line)
    if not errors.isEmpty():
        raise ContractError(errors)
    return valid
