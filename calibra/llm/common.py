"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.session import scratch_path, scratch_root

__all__ = [
    "WORD", "long_array", "double_array", "fresh_names", "keep_columns", "materialize", "scratch_path", "scratch_root",
    "stage_tables", "unit",
]

_OPEN: list[list[str]] = []  # tables of the stage that runs now
_PAST: dict[str, list[str]] = {}  # by application: tables of the stage before

#: A word of every operator here: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    if _OPEN:
        _OPEN[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def stage_tables(spark: SparkSession) -> Iterator[None]:
    """Drop what the stage before wrote for itself, and note what this one writes.

    To be entered only when the result of the stage before is written.
    """
    context = spark.sparkContext
    for path in _PAST.pop(context.applicationId, []):
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    _OPEN.append([])
    try:
        yield
    finally:
        _PAST[context.applicationId] = _OPEN.pop()


def long_array(values: Iterable[int]) -> Column:
    """A literal array of longs, for lookups by position in generated code."""
    items = ",".join(f"{int(v)}L" for v in values)
    return F.expr(f"array({items})" if items else "cast(array() as array<bigint>)")


def double_array(values: Iterable[float]) -> Column:
    items = ",".join(f"{float(v)!r}D" for v in values)
    return F.expr(f"array({items})" if items else "cast(array() as array<double>)")


def unit(*parts: Column | str) -> Column:
    """A repeatable draw from [0, 1) that depends on the given columns only."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def keep_columns(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The given names as far as ``df`` has them."""
    have = set(df.columns)
    return [n for n in names if n in have]


def fresh_names(df: DataFrame, *names: str) -> dict[str, str]:
    """For each name one that no column of ``df`` has, whatever its case."""
    have = {c.lower() for c in df.columns}
    out = {}
    for name in names:
        new = f"own_{name}"
        while new.lower() in have:
            new += "_"
        out[name] = new
    return out
