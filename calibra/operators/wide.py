"""Features of any width: levels in a table, sparse vectors, iterative reduction.

The levels of all categorical columns are numbered by a range-partitioned sort
and kept as a table of column, level and place. Encoding joins that table once
per categorical column: a counted small side is broadcast, a large one meets
the rows by a shuffle, in which hot levels can be split. A row becomes a sparse
vector of its set places, whatever the width.

The reducer needs the leading right singular vectors only. For encoded levels
they come from a table of the products of features that meet in a row, by
repeated products with a table of vectors: a row a feature, so neither the
driver nor a task holds anything of the width. Encoded rows have one entry for
each column of the table, and the products are few. Rows without levels are as
dense as their table is wide; there the vectors come from products of the rows
with vectors of the width, which the driver holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.feature import PCAModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseMatrix, Vectors, VectorUDT
from pyspark.ml.wrapper import JavaParams
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibra.config import MISSING_CATEGORY
from calibra.operators.ordering import sorted_index
from calibra.session import materialize, small_side

ASSEMBLED = "__assembled"
OVERSAMPLE = 10  # further vectors of the iteration, for its speed
MOST_STEPS = 300


@dataclass(frozen=True)
class FeatureGroups:
    scaled: list[str]
    categorical: list[str]
    passthrough: list[str]

    def as_dict(self) -> dict[str, list[str]]:
        return {
            "scaled_columns": self.scaled,
            "categorical_columns": self.categorical,
            "passthrough_numeric_columns": self.passthrough,
        }


def category(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(MISSING_CATEGORY))


def category_levels(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows ``(column, level, count)`` for all columns from one pass."""
    rows = F.array(*[F.struct(F.lit(c).alias("column"), category(c).alias("level")) for c in columns])
    return df.select(F.inline(rows)).groupBy("column", "level").agg(F.count(F.lit(1)).alias("count"))


def level_dictionary(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[int]]:
    """Rows ``(col, level, code)`` with the place of each level within its column, and the columns' sizes.

    ``col`` counts the columns; levels are in the order of their bytes.
    """
    number = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column")).cast("int") - 1
    levels = category_levels(df, columns).select(number.alias("col"), "level")
    table = materialize(sorted_index(levels, ["col", "level"], "code", within="col")[0], "levels")
    found = {r["col"]: r["count"] for r in table.groupBy("col").count().collect()}  # one row a column
    return table, [found.get(i, 0) for i in range(len(columns))]


def sparse_vector(size: int, entries: Column) -> Column:
    """A sparse vector from an array of ``(place, value)`` in ascending places.

    The vector type has no constructor in SQL; reading its fields back as that
    type stays on the JVM side.
    """
    fields = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(size).alias("size"),
        F.transform(entries, lambda e: e["place"]).alias("indices"),
        F.transform(entries, lambda e: e["value"]).alias("values"),
    )
    shape = T.StructType([T.StructField("v", VectorUDT())])
    return F.from_json(F.to_json(F.struct(fields.alias("v"))), shape)["v"]


def vector_entries(vector: str) -> Column:
    """The set entries of a vector column, sparse or dense, as an array of ``(place, value)``."""
    v = F.unwrap_udt(vector)
    places = F.coalesce(v["indices"], F.sequence(F.lit(0), F.size(v["values"]) - 1))
    both = F.transform(F.arrays_zip(places.alias("place"), v["values"].alias("value")), lambda e: F.struct(e["place"].alias("place"), e["value"].alias("value")))
    return F.filter(both, lambda e: e["value"] != 0)


@dataclass(frozen=True)
class WideEncoder:
    """Fitted imputation, scaling and encoding with the levels in a table.

    Order of the places: scaled, levels of each categorical column, passthrough.
    A level unseen in fitting, and a zero, has no entry.
    """

    groups: FeatureGroups
    fills: dict[str, float]
    params: dict[str, tuple[float, float]]
    sizes: list[int]
    levels: DataFrame
    weights: DataFrame | None = None  # (place, weights) of a reducer, whose scores then come instead of the vector

    @classmethod
    def fit(cls, df: DataFrame, groups: FeatureGroups, fills: dict[str, float], params: dict[str, tuple[float, float]]) -> WideEncoder:
        levels, sizes = level_dictionary(df, groups.categorical)
        return cls(groups, fills, params, sizes, levels)

    @property
    def width(self) -> int:
        return len(self.groups.scaled) + sum(self.sizes) + len(self.groups.passthrough)

    def _first(self, column: int) -> int:
        return len(self.groups.scaled) + sum(self.sizes[:column])

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the sparse vector, or the scores of the reducer, in a further column."""
        if self.weights is not None:
            return self._scores(df)
        return self.entries(df).withColumn(ASSEMBLED, sparse_vector(self.width, F.col("__entries"))).drop("__entries")

    def numbers(self) -> dict[int, Column]:
        """Value of each numeric feature by its place."""
        filled = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(self.fills[c]))
        last = self._first(len(self.sizes))
        scaled = {i: (filled(c) - F.lit(self.params[c][0])) / F.lit(self.params[c][1]) for i, c in enumerate(self.groups.scaled)}
        return scaled | {last + i: filled(c) for i, c in enumerate(self.groups.passthrough)}

    def entries(self, df: DataFrame) -> DataFrame:
        """``df`` with the set ``(place, value)`` of every row, in ascending places, as ``__entries``."""
        out = df
        for i, c in enumerate(self.groups.categorical):
            side = self.levels.where(F.col("col") == i).select(F.col("level").alias(f"__level_{i}"), F.col("code").cast("int").alias(f"__code_{i}"))
            out = out.join(small_side(side, self.sizes[i]), category(c) == F.col(f"__level_{i}"), "left")
        entry = lambda place, value: F.struct(place.cast("int").alias("place"), value.alias("value"))
        parts = [entry(F.lit(place), value) for place, value in self.numbers().items()]
        hot = [entry(F.col(f"__code_{i}") + self._first(i), F.lit(1.0)) for i in range(len(self.groups.categorical))]
        parts[len(self.groups.scaled) : len(self.groups.scaled)] = hot
        entries = F.filter(F.array(*parts), lambda e: e["place"].isNotNull() & (e["value"] != 0))
        return out.withColumn("__entries", entries).select(*df.columns, "__entries")

    def _scores(self, df: DataFrame) -> DataFrame:
        """The products of the vectors with the weights, which are joined by level like the places."""
        numbers = self.numbers()
        own = {r["place"]: r["weights"] for r in self.weights.filter(F.col("place").isin([*numbers])).collect()}  # one a numeric column
        parts = [F.array(*[F.lit(w) * value for w in own[place]]) for place, value in numbers.items() if place in own]
        out = df
        firsts = F.array(*[F.lit(self._first(i)) for i in range(len(self.sizes))])
        placed = self.levels.withColumn("place", (F.get(firsts, "col") + F.col("code")).cast("int")).join(self.weights, "place")
        for i, c in enumerate(self.groups.categorical):
            side = placed.where(F.col("col") == i).select(F.col("level").alias(f"__level_{i}"), F.col("weights").alias(f"__weights_{i}"))
            out = out.join(small_side(side, self.sizes[i]), category(c) == F.col(f"__level_{i}"), "left")
            parts.append(F.col(f"__weights_{i}"))
        k = len(self.weights.first()["weights"])
        total = F.array_repeat(F.lit(0.0), k)
        for part in parts:
            total = F.zip_with(total, F.coalesce(part, F.array_repeat(F.lit(0.0), k)), lambda a, b: a + b)
        return out.withColumn(ASSEMBLED, array_to_vector(total)).select(*df.columns, ASSEMBLED)

    def variance(self, df: DataFrame, counts: DataFrame) -> float:
        """Sum of the sample variances of all features; ``counts`` has the rows ``c`` of every level."""
        numbers = [F.var_samp(v) for v in self.numbers().values()]
        row = df.agg(F.count(F.lit(1)), *numbers).first()
        n = row[0]
        levels = counts.agg(F.sum(F.col("c") * (F.lit(float(n)) - F.col("c")))).first()[0] or 0.0
        return float(sum(v or 0.0 for v in row[1:])) + levels / n / max(1, n - 1)

    def names(self) -> DataFrame:
        """Rows ``(place, name)`` of all features."""
        spark = self.levels.sparkSession
        last = self._first(len(self.sizes))
        plain = [(i, f"scaled_numeric__{c}") for i, c in enumerate(self.groups.scaled)]
        plain += [(last + i, f"passthrough_numeric__{c}") for i, c in enumerate(self.groups.passthrough)]
        firsts = F.array(*[F.lit(self._first(i)) for i in range(len(self.sizes))])
        columns = F.array(*[F.lit(c) for c in self.groups.categorical])
        own = self.levels.select(
            (F.get(firsts, "col") + F.col("code")).alias("place"),
            F.concat(F.lit("encoded_categorical__"), F.get(columns, "col"), F.lit("_"), "level").alias("name"),
        )
        return spark.createDataFrame(plain, "place bigint, name string").unionByName(own)

    def document(self) -> dict:
        """What a reader needs beside the table of levels."""
        return {**self.groups.as_dict(), "fills": self.fills, "scale": {c: list(p) for c, p in self.params.items()}, "sizes": self.sizes}

    @classmethod
    def restore(cls, spark: SparkSession, document: dict, path: str, weights: str | None = None) -> WideEncoder:
        groups = FeatureGroups(document["scaled_columns"], document["categorical_columns"], document["passthrough_numeric_columns"])
        scale = {c: (p[0], p[1]) for c, p in document["scale"].items()}
        return cls(groups, document["fills"], scale, document["sizes"], spark.read.parquet(path), spark.read.parquet(weights) if weights else None)


def _times(vectors: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Rows ``(place, weights)`` with the row vectors multiplied by a small matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("weights").flatten().to_numpy(zero_copy_only=False).reshape(-1, matrix.shape[0]) @ matrix
            ends = np.arange(len(v) + 1, dtype="int32") * matrix.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column("place"), pa.ListArray.from_arrays(ends, v.ravel())], ["place", "weights"])

    return vectors.mapInArrow(run, "place int, weights array<double>")


def _inner(rows: DataFrame, left: str, right: str) -> np.ndarray:
    """``left`` transposed times ``right``, two columns of row vectors: a small matrix a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            if batch.num_rows:
                a, b = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("a", "b"))
                total = total + a.T @ b
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["m"])

    parts = rows.select(F.col(left).alias("a"), F.col(right).alias("b")).mapInArrow(run, "m array<double>").toLocalIterator()
    total = sum(np.array(r["m"]) for r in parts)
    size = int(round(len(total) ** 0.5))
    return total.reshape(size, size)


def _orthonormal(vectors: DataFrame) -> DataFrame:
    """An orthonormal basis of the columns, written once; two rounds, as one loses digits."""
    for _ in range(2):
        values, axes = np.linalg.eigh(_inner(vectors, "weights", "weights"))
        kept = values > 1e-14 * max(values[-1], 1e-300)
        vectors = materialize(_times(vectors, axes[:, kept] / np.sqrt(values[kept])), "basis")
    return vectors


def leading_weights(entries: DataFrame, k: int, width: int) -> tuple[DataFrame, DataFrame]:
    """The leading right singular vectors of rows of ``__entries`` as ``(place, weights)``, and the products.

    Subspace iteration with ``OVERSAMPLE`` further vectors until the values
    stand still. The products ``(i, j, g)`` of features that meet in a row are
    summed once; a row makes the square of its number of entries. Fewer vectors
    come back when the rank is lower.
    """
    pairs = entries.select("__entries", F.inline("__entries").alias("i", "a")).select("i", "a", F.inline("__entries").alias("j", "b"))
    gram = materialize(pairs.groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("g")), "gram")

    def product(vectors: DataFrame, size: int) -> DataFrame:
        met = gram.join(vectors, F.col("j") == F.col("place"))
        sums = met.groupBy("i").agg(*[F.sum(F.col("g") * F.get("weights", F.lit(c))).alias(f"w{c}") for c in range(size)])
        return sums.select(F.col("i").alias("place"), F.array(*[f"w{c}" for c in range(size)]).alias("weights"))

    size = min(width, k + OVERSAMPLE)
    draw = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda c: F.pmod(F.xxhash64("i", c), F.lit(1 << 30)) / F.lit(float(1 << 29)) - 1)
    basis = _orthonormal(gram.filter("i = j").select(F.col("i").alias("place"), draw.alias("weights")))
    before = np.zeros(0)
    for _ in range(MOST_STEPS):
        size = len(basis.first()["weights"])
        image = product(basis, size).withColumnRenamed("weights", "image")
        both = materialize(basis.join(image, "place"), "image")
        values, axes = np.linalg.eigh(_inner(both, "weights", "image"))
        values, axes = values[::-1], axes[:, ::-1]
        top = values[:k]
        if len(before) == len(top) and np.abs(top - before).max() <= 1e-13 * top[0]:
            break
        before = top
        kept = values > 1e-14 * values[0]
        basis = _orthonormal(_times(both.select("place", F.col("image").alias("weights")), axes[:, kept] / values[kept]))
    kept = min(k, int((values > 1e-14 * values[0]).sum()))
    found = materialize(_times(both.select("place", "weights"), axes[:, :kept]), "vectors")
    # The entry of the largest size is positive, the first of equal ones.
    largest = [F.max_by(F.get("weights", F.lit(c)), F.struct(F.abs(F.get("weights", F.lit(c))), -F.col("place"))) for c in range(kept)]
    signs = np.array([1.0 if v >= 0 else -1.0 for v in found.agg(*largest).first()])
    return materialize(_times(found, np.diag(signs)), "weights"), gram


def right_singular(rows: DataFrame, column: str, k: int, width: int) -> tuple[np.ndarray, list[float], int]:
    """The leading right singular vectors (a column each), the singular values and the number of rows.

    Implicitly restarted Lanczos: each step is one pass over the rows, which are
    written once and cached. Fewer vectors come back when the rank is lower.
    """
    held = materialize(rows.select(column), "reducer-rows")
    kept = MLUtils.convertVectorColumnsFromML(held, column).persist(StorageLevel.MEMORY_AND_DISK)
    count = kept.count()
    try:
        found = RowMatrix(kept, count, width).computeSVD(max(1, min(k, width - 1, count)))
        return found.V.toArray(), [float(v) for v in found.s], count
    finally:
        kept.unpersist()


def projection(vectors: np.ndarray, weights: list[float], source: str, out: str) -> PCAModel:
    """A stage that multiplies a vector column with the given ones."""
    width, k = vectors.shape
    matrix = DenseMatrix(width, k, vectors.flatten(order="F"))
    uid = JavaParams._new_java_obj("org.apache.spark.ml.feature.PCA").uid()
    model = PCAModel(JavaParams._new_java_obj("org.apache.spark.ml.feature.PCAModel", uid, matrix, Vectors.dense(weights)))
    return model._set(k=k, inputCol=source, outputCol=out)
