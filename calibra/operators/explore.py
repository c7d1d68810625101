"""Exploration data: correlations, histograms, class boxes, scatter bins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.functions.types import is_numeric, numeric_columns
from calibra.operators.clean import denied_columns, nan_to_null
from calibra.operators.quantiles import exact_quantiles
from calibra.session import checked_side, small_side

BINS = 30
PAGE = 9


def _correlations(df: DataFrame, names: list[str]) -> DataFrame:
    """Matrix products per Arrow batch, one small matrix per task.

    Values are shifted by the column mean first, so the sums stay accurate.
    """
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(names)]).first()
    shift = np.array([m if m is not None else 0.0 for m in means], dtype=float)
    p = len(names)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((6, p, p))
        for batch in batches:
            values = batch.to_numpy(dtype=float) - shift
            seen = (~np.isnan(values)).astype(float)
            values = np.nan_to_num(values)
            squares = values * values
            sums[0] += seen.T @ seen
            sums[1] += values.T @ seen
            sums[2] += seen.T @ values
            sums[3] += squares.T @ seen
            sums[4] += seen.T @ squares
            sums[5] += values.T @ values
        i, j = np.triu_indices(p, 1)
        yield pd.DataFrame({"i": i, "j": j, **{f"s{k}": sums[k][i, j] for k in range(6)}})

    schema = "i int, j int, " + ", ".join(f"s{k} double" for k in range(6))
    sums = (
        df.select(*[F.col(c).cast("double").alias(c) for c in names])
        .mapInPandas(partial, schema)
        .groupBy("i", "j")
        .agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(6)])
    )
    n, sx, sy, sxx, syy, sxy = [F.col(f"s{k}") for k in range(6)]
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    # Rounding can leave a tiny rest on constant columns; it counts as zero.
    flat = (vx <= sxx * n * 1e-13) | (vy <= syy * n * 1e-13)
    name = F.array(*[F.lit(c) for c in names])
    return sums.select(
        (F.col("i") + 1).alias("i"),
        (F.col("j") + 1).alias("j"),
        name[F.col("i")].alias("column_i"),
        name[F.col("j")].alias("column_j"),
        F.when(~flat, F.try_divide(n * sxy - sx * sy, F.sqrt(vx) * F.sqrt(vy))).alias("corr"),
    )


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Upper triangle of the Pearson matrix as ``(i, j, column_i, column_j, corr)``."""
    df = nan_to_null(df)
    names = columns or numeric_columns(df)
    if len(names) < 2:
        return df.sparkSession.createDataFrame(
            [], "i int, j int, column_i string, column_j string, corr double"
        )
    return _correlations(df, names)


def correlated_columns(df: DataFrame, threshold: float = 0.95, columns: list[str] | None = None) -> DataFrame:
    """Columns whose correlation with any earlier column exceeds the limit."""
    return (
        correlation_matrix(df, columns)
        .filter(F.abs("corr") > threshold)
        .select(F.col("column_j").alias("column"))
        .distinct()
    )


def drop_correlated_columns(df: DataFrame, threshold: float = 0.95) -> tuple[DataFrame, list[str]]:
    found = {r["column"] for r in correlated_columns(df, threshold).collect()}
    names = [c for c in df.columns if c in found]
    return df.drop(*names), names


def _range_bin(value: Column, low: Column, width: Column, bins: int) -> Column:
    place = F.least(F.floor((value - low) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))
    return F.when(width > 0, place).otherwise(F.lit(0)).cast("int")


def _ranges(df: DataFrame, columns: list[str], bins: int) -> tuple[Column, Column]:
    """Lowest value and bin width per column, as arrays from one scalar subquery."""
    lows = [F.min(F.col(c).cast("double")) for c in columns]
    widths = [(F.max(F.col(c).cast("double")) - F.min(F.col(c).cast("double"))) / bins for c in columns]
    ranges = df.agg(F.struct(F.array(*lows).alias("low"), F.array(*widths).alias("width")).alias("r")).scalar()
    return ranges.getField("low"), ranges.getField("width")


def long_values(df: DataFrame, columns: list[str], *carry: Column | str) -> DataFrame:
    """Rows ``(carry..., col, value)`` for the non-null values of numeric columns.

    ``col`` is the position in ``columns``. What is computed per value comes
    after the explode as one small expression, so that the generated code stays
    short enough to be compiled for any number of columns.
    """
    values = F.array(*[F.col(c).cast("double") for c in columns])
    return df.select(*carry, F.posexplode(values).alias("col", "value")).filter(F.col("value").isNotNull())


def _name_of(names: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in names]), index)


def _count_codes(codes: DataFrame) -> DataFrame:
    return codes.groupBy("code").agg(F.count(F.lit(1)).alias("count"))


def histograms(df: DataFrame, columns: list[str] | None = None, bins: int = BINS, page: int = PAGE) -> DataFrame:
    """Equal-width counts per numeric column, with the page the column is shown on."""
    df = nan_to_null(df)
    names = columns or numeric_columns(df)
    low, width = _ranges(df, names, bins)
    place = _range_bin(F.col("value"), F.get(low, F.col("col")), F.get(width, F.col("col")), bins)
    # One integer per value names column and bin, so the grouping key is small.
    counts = _count_codes(long_values(df, names).select((F.col("col") * bins + place).alias("code")))
    at = F.floor(F.col("code") / bins).cast("int")
    return counts.select(
        _name_of(names, at).alias("column"),
        (F.floor(at / page).cast("int") + 1).alias("page"),
        (F.col("code") % bins).alias("bin"),
        "count",
    )


def scatter_bins(df: DataFrame, columns: list[str], target: str, bins: int = BINS) -> DataFrame:
    """2-D counts of each feature against a numeric target."""
    if not is_numeric(df.schema[target].dataType):
        raise ValueError("scatter bins need a numeric target; use class boxes")
    df = nan_to_null(df)
    low, width = _ranges(df, [*columns, target], bins)
    y = F.col(target).cast("double")
    y_bin = _range_bin(y, F.get(low, F.lit(len(columns))), F.get(width, F.lit(len(columns))), bins)
    rows = long_values(df.filter(y.isNotNull()), columns, y_bin.alias("y"))
    x_bin = _range_bin(F.col("value"), F.get(low, F.col("col")), F.get(width, F.col("col")), bins)
    counts = _count_codes(rows.select(((F.col("col") * bins + x_bin) * bins + F.col("y")).alias("code")))
    code = F.col("code")
    return counts.select(
        _name_of(columns, F.floor(code / (bins * bins)).cast("int")).alias("column"),
        (F.floor(code / bins).cast("int") % bins).alias("x_bin"),
        (code % bins).alias("y_bin"),
        "count",
    )


def box_by_class(df: DataFrame, columns: list[str], target: str, class_bound: float | None = None) -> DataFrame:
    """Box figures per class and column: quartiles, 1.5 IQR whiskers, outliers."""
    df = nan_to_null(df)
    quart = exact_quantiles(df, columns, [0.25, 0.5, 0.75], [target], class_bound)
    iqr = F.col("q2") - F.col("q0")
    fences = quart.select(
        F.col(target).alias("__class"),
        F.col("column").alias("__column"),
        "n",
        F.col("q0").alias("q1"),
        F.col("q1").alias("median"),
        F.col("q2").alias("q3"),
        (F.col("q0") - 1.5 * iqr).alias("lo"),
        (F.col("q2") + 1.5 * iqr).alias("hi"),
    )
    rows = long_values(df, columns, target).withColumn("column", _name_of(columns, F.col("col")))
    side = small_side(fences, class_bound * len(columns)) if class_bound else checked_side(fences, "fences")
    joined = rows.join(
        side,
        F.col(target).eqNullSafe(F.col("__class")) & (F.col("column") == F.col("__column")),
    )
    inside = (F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi"))
    return joined.groupBy(target, "column").agg(
        *[F.first(c).alias(c) for c in ("n", "q1", "median", "q3")],
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count(F.when(~inside, 1)).alias("outliers"),
    )


def feature_pages(columns: list[str], page: int = PAGE) -> list[list[str]]:
    return [columns[i : i + page] for i in range(0, len(columns), page)]


def exploration_metadata(df: DataFrame, target: str, deny_list: tuple[str, ...] = ()) -> DataFrame:
    """Explored and skipped columns with page and value count.

    Skipped are denied and non-numeric columns; without any numeric column the
    result is empty.
    """
    denied = denied_columns(df, deny_list, target)
    rest = [c for c in df.columns if c not in denied and c != target]
    numeric = [c for c in rest if c in numeric_columns(df)]
    roles = (
        [(c, "numeric", i // PAGE + 1) for i, c in enumerate(numeric)]
        + [(c, "denied", None) for c in denied]
        + [(c, "not_numeric", None) for c in rest if c not in numeric]
    )
    if not numeric:
        roles = []
    names = [c for c, _, _ in roles]
    counts = nan_to_null(df).agg(
        F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(names)]
    )
    schema = "array<struct<column:string,role:string,page:int,non_null:bigint>>"
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(role).alias("role"),
            F.lit(page).cast("int").alias("page"),
            F.col(f"c{i}").alias("non_null"),
        )
        for i, (c, role, page) in enumerate(roles)
    ]
    return counts.select(F.inline(F.array(*rows).cast(schema)))
