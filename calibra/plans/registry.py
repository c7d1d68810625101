"""Registry of named queries: a Spark builder and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

BUILDERS: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


@dataclass(frozen=True)
class Source:
    """A test table with derived columns, written once for both engines.

    The expressions are valid in Spark SQL and in the oracle's SQL.
    """

    table: str
    columns: tuple[str, ...]
    doubled: bool = False  # every row twice, to have copies

    def load(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = load(spark, sf_dir, self.table).selectExpr(*self.columns)
        return df.unionAll(df) if self.doubled else df

    @property
    def sql(self) -> str:
        one = f"SELECT {', '.join(self.columns)} FROM {self.table}"
        return f"({one} UNION ALL {one})" if self.doubled else f"({one})"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def add(builder: Builder) -> Builder:
        if name in BUILDERS:
            raise ValueError(f"query {name} is registered twice")
        BUILDERS[name] = builder
        if sql is not None:
            ORACLES[name] = sql
        return builder

    return add


def tag(value: str) -> str:
    """SQL text literal."""
    return "'" + value.replace("'", "''") + "'"
