"""Feature preparation: impute, scale, encode, assemble, reduce.

Fitting needs one value per column (median, mean, deviation) and the levels of
the categorical columns. Up to ``PreparePolicy.max_width`` levels the fitted
transform is one Spark ML ``PipelineModel`` of SQL, indexer, encoder, assembler
and PCA stages. Beyond, no list of levels exists anywhere: a dictionary table is
joined to the rows, which become sparse vectors (``operators.wide``), and the
reducer multiplies the rows with vectors instead of building a square matrix.
Everything runs on the JVM side.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    PCA,
    ElementwiseProduct,
    OneHotEncoder,
    SQLTransformer,
    StandardScaler,
    StringIndexerModel,
    VectorAssembler,
    VectorSlicer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.config import MISSING_CATEGORY, PreparePolicy
from calibra.functions.types import numeric_columns, string_columns
from calibra.operators.ordering import sorted_index
from calibra.operators.profile import Recommendations
from calibra.operators.quantiles import medians
from calibra.operators.wide import ASSEMBLED, FeatureGroups, WideEncoder, category, category_levels, leading_weights, projection, right_singular
from calibra.session import small_side

FEATURES = "features"
ROWS_A_LEVEL = 16  # rows that are looked at first, for each level of the limit


def feature_groups(df: DataFrame, rec: Recommendations, exclude: tuple[str, ...] = ()) -> FeatureGroups:
    """Scaled = recommended numeric, passthrough = other numeric, categorical = all text left."""
    numeric = numeric_columns(df, exclude)
    scaled = [c for c in rec.scale if c in numeric]
    return FeatureGroups(scaled, string_columns(df, exclude), [c for c in numeric if c not in scaled])


# --- numeric columns -------------------------------------------------------


def impute_median(df: DataFrame, columns: list[str], values: dict[str, float] | None = None) -> DataFrame:
    """Fill nulls with the exact median; a column without values stays null."""
    values = medians(df, columns) if values is None else values
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(values[c])) for c in columns if values.get(c) is not None}
    )


def scale_parameters(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; zero deviation counts as one."""
    if not columns:
        return {}
    aggs: list[Column] = []
    for i, c in enumerate(columns):
        aggs += [F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """Median imputation, then ``(x - mean) / population deviation``."""
    filled = impute_median(df, columns)
    params = scale_parameters(filled, columns)
    return filled.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in params.items()})


# --- categorical columns ---------------------------------------------------


def impute_category(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: category(c) for c in columns})


def narrow_levels(df: DataFrame, columns: list[str], most: int) -> dict[str, list[str]] | None:
    """Sorted levels per column, or nothing when there are more than ``most`` together."""
    if not columns:
        return {}
    # Often some rows have too many levels already; only otherwise are all rows counted.
    for part in (df.limit(ROWS_A_LEVEL * most), df):
        rows = category_levels(part, columns).select("column", "level").limit(most + 1).collect()
        if len(rows) > most:
            return None
    found: dict[str, list[str]] = {c: [] for c in columns}
    for r in rows:
        found[r["column"]].append(r["level"])
    return {c: sorted(v, key=lambda s: s.encode()) for c, v in found.items()}


def one_hot_long(df: DataFrame, key: str, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """One-hot as rows ``(key, column, level_index)``: the set positions only.

    Levels come from ``fit_on`` (default: the data itself), sorted. A level
    unseen there has no row, the long form of an all-zero vector.
    """
    levels = category_levels(df if fit_on is None else fit_on, columns)
    index, total = sorted_index(levels, ["column", "level"], "level_index", within="column")
    index = small_side(index.withColumnsRenamed({"column": "__column", "level": "__level"}), total)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), category(c).alias("level")) for c in columns])
    return (
        df.select(key, F.inline(rows))
        .join(index, (F.col("column") == F.col("__column")) & (F.col("level") == F.col("__level")))
        .select(key, "column", "level", "level_index")
    )


def integer_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace text columns by their 0-based position in sorted order.

    Missing text is filled first and so is a level of its own.
    """
    out = impute_category(df, columns)
    order = df.columns
    for c in columns:
        codes, total = sorted_index(out.select(c).distinct(), [c], "__code")
        side = small_side(codes.withColumnRenamed(c, "__level"), total)
        out = out.join(side, F.col(c) == F.col("__level")).drop("__level", c).withColumnRenamed("__code", c)
    return out.select(*order)


# --- fitted transform --------------------------------------------------------


@dataclass(frozen=True)
class FittedFeatures:
    model: PipelineModel
    groups: FeatureGroups
    width: int
    method: str | None
    names: list[str]  # empty for wide features that were not reduced: see ``WideEncoder.names``
    explained: list[float]
    wide: WideEncoder | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        keep = [c for c in df.columns]
        return self.model.transform(self.wide.transform(df) if self.wide else df).select(*keep, FEATURES)


def _sql_literal(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


def _number_stage(
    groups: FeatureGroups, fills: dict[str, float], params: dict[str, tuple[float, float]]
) -> SQLTransformer:
    parts = []
    for i, c in enumerate(groups.scaled):
        m, s = params[c]
        fill = f"coalesce(CAST(`{c}` AS DOUBLE), {_sql_literal(fills[c])})"
        parts.append(f"({fill} - {_sql_literal(m)}) / {_sql_literal(s)} AS __scaled_{i}")
    for i, c in enumerate(groups.categorical):
        parts.append(f"coalesce(CAST(`{c}` AS STRING), '{MISSING_CATEGORY}') AS __text_{i}")
    for i, c in enumerate(groups.passthrough):
        parts.append(f"coalesce(CAST(`{c}` AS DOUBLE), {_sql_literal(fills[c])}) AS __plain_{i}")
    return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")


def fit_features(
    df: DataFrame, groups: FeatureGroups, policy: PreparePolicy = PreparePolicy()
) -> FittedFeatures:
    """Fit imputation, scaling, encoding and the reducer on ``df``.

    Output order: scaled, one-hot, passthrough. A numeric column without any
    value has no median and is left out.
    """
    numeric = [*groups.scaled, *groups.passthrough]
    fills = medians(df, numeric)
    groups = FeatureGroups(
        [c for c in groups.scaled if fills.get(c) is not None],
        groups.categorical,
        [c for c in groups.passthrough if fills.get(c) is not None],
    )
    if not (groups.scaled or groups.categorical or groups.passthrough):
        raise ValueError("no feature column is left after cleaning")
    params = scale_parameters(impute_median(df, groups.scaled, fills), groups.scaled)
    levels = narrow_levels(df, groups.categorical, policy.max_width)
    if levels is None:
        return _fit_wide(df, WideEncoder.fit(df, groups, fills, params), policy)
    stages = [_number_stage(groups, fills, params)]
    names = [f"scaled_numeric__{c}" for c in groups.scaled]
    inputs = [f"__scaled_{i}" for i in range(len(groups.scaled))]
    if groups.categorical:
        texts = [f"__text_{i}" for i in range(len(groups.categorical))]
        codes = [f"__code_{i}" for i in range(len(groups.categorical))]
        hots = [f"__hot_{i}" for i in range(len(groups.categorical))]
        indexers = [
            StringIndexerModel.from_labels(levels[c], inputCol=texts[i], outputCol=codes[i], handleInvalid="keep")
            for i, c in enumerate(groups.categorical)
        ]
        stages += indexers
        # The indexer's slot for unseen levels is the one the encoder drops,
        # so an unseen level becomes the zero vector. The encoder reads the
        # sizes from the indexers, not from data.
        encoder = OneHotEncoder(inputCols=codes, outputCols=hots, dropLast=True, handleInvalid="error")
        stages.append(encoder.fit(PipelineModel(list(stages)).transform(df.limit(0))))
        inputs += hots
        names += [f"encoded_categorical__{c}_{v}" for c in groups.categorical for v in levels[c]]
    inputs += [f"__plain_{i}" for i in range(len(groups.passthrough))]
    names += [f"passthrough_numeric__{c}" for c in groups.passthrough]
    stages.append(VectorAssembler(inputCols=inputs, outputCol=ASSEMBLED, handleInvalid="error"))
    width = len(names)
    method, k = choose_reducer(width, bool(groups.categorical), policy)
    explained: list[float] = []
    if method is None:
        stages.append(SQLTransformer(statement=f"SELECT *, {ASSEMBLED} AS {FEATURES} FROM __THIS__"))
    else:
        assembled = PipelineModel(stages).transform(df).select(ASSEMBLED)
        reducer, explained = _fit_reducer(assembled, method, k, width, policy)
        stages += reducer
        names = component_names(method, len(explained))
    return FittedFeatures(PipelineModel(stages), groups, width, method, names, explained)


def _fit_wide(df: DataFrame, encoder: WideEncoder, policy: PreparePolicy) -> FittedFeatures:
    """The reducer for vectors whose levels are joined from a dictionary."""
    width = encoder.width
    method, k = choose_reducer(width, True, policy)
    stages: list = [SQLTransformer(statement=f"SELECT *, {ASSEMBLED} AS {FEATURES} FROM __THIS__")]
    if method is None:
        return FittedFeatures(PipelineModel(stages), encoder.groups, width, None, [], [], encoder)
    weights, products = leading_weights(encoder.entries(df), k, width)
    reduced = replace(encoder, weights=weights)
    kept = reduced.transform(df).select(Summarizer.variance(F.col(ASSEMBLED)).alias("kept")).first()["kept"]
    numbers = [*encoder.numbers()]
    levels = products.filter((F.col("i") == F.col("j")) & ~F.col("i").isin(numbers)).select(F.col("g").alias("c"))
    total = encoder.variance(df, levels) or 1.0
    explained = [float(v) / total for v in kept]
    return FittedFeatures(PipelineModel(stages), encoder.groups, width, method, component_names(method, len(explained)), explained, reduced)


def _fit_reducer(assembled: DataFrame, method: str, k: float | int, width: int, policy: PreparePolicy) -> tuple[list, list[float]]:
    gram = width <= policy.max_width  # a square matrix of that width fits in the driver
    if method == "svd":
        return fit_svd(assembled, k, width, gram)
    return fit_pca(assembled, k, width, gram)


def choose_reducer(width: int, sparse: bool, policy: PreparePolicy) -> tuple[str | None, float | int]:
    """SVD for one-hot or very wide data, PCA otherwise, none for one column."""
    asked = policy.components
    if not policy.enable_reduction or width <= 1:
        return None, 0
    whole = isinstance(asked, int) and not isinstance(asked, bool)
    # Fixed value: width above which a variance share is no longer solved by PCA.
    if sparse or (not whole and 0 < asked < 1 and width > 1000):
        if whole:
            return "svd", max(1, min(asked, width - 1))
        return "svd", max(2, min(policy.sparse_components, width - 1))
    return "pca", asked


def component_names(prefix: str, count: int) -> list[str]:
    return [f"{prefix}_{i:03d}" for i in range(1, count + 1)]


def _signs(components) -> list[float]:
    import numpy as np

    matrix = components.toArray()
    top = matrix[np.abs(matrix).argmax(axis=0), np.arange(matrix.shape[1])]
    return [1.0 if v >= 0 else -1.0 for v in top]


def _flip_stage(signs: list[float], input_col: str) -> ElementwiseProduct:
    return ElementwiseProduct(scalingVec=Vectors.dense(signs), inputCol=input_col, outputCol=FEATURES)


def fit_pca(assembled: DataFrame, components: float | int, width: int, gram: bool = True) -> tuple[list, list[float]]:
    """Centred PCA. A share takes the fewest components whose sum exceeds it.

    Without ``gram`` the components come from products of rows and vectors.
    """
    center = StandardScaler(withMean=True, withStd=False, inputCol=ASSEMBLED, outputCol="__centred").fit(assembled)
    share = not (isinstance(components, int) and not isinstance(components, bool))
    k = width if share else max(1, min(components, width))
    if gram:
        model = PCA(k=k, inputCol="__centred", outputCol="__scores").fit(center.transform(assembled))
        ratios = [float(v) for v in model.explainedVariance]
    else:
        k = min(k, width - 1)
        vectors, values, rows = right_singular(center.transform(assembled), "__centred", k, width)
        total = assembled.select(Summarizer.variance(F.col(ASSEMBLED)).alias("v")).first()["v"]
        spread = float(sum(total)) * max(1, rows - 1) or 1.0
        ratios, k = [v * v / spread for v in values], len(values)
        model = projection(vectors, ratios, "__centred", "__scores")
    keep = k
    if share:
        total = 0.0
        for keep, ratio in enumerate(ratios, 1):
            total += ratio
            if total > components:
                break
    signs = _signs(model.pc)[:keep]
    stages = [center, model]
    source = "__scores"
    if keep < k:
        stages.append(VectorSlicer(indices=list(range(keep)), inputCol="__scores", outputCol="__kept"))
        source = "__kept"
    return [*stages, _flip_stage(signs, source)], ratios[:keep]


def fit_svd(assembled: DataFrame, k: int, width: int, gram: bool = True) -> tuple[list, list[float]]:
    """Truncated SVD without centring.

    With ``gram``: every row together with its negative has mean zero, so the
    principal axes of that union are the right singular vectors of the rows.
    Without, the vectors come from repeated products with the rows, and nothing
    of width times width is ever held.
    """
    if gram:
        negate = ElementwiseProduct(scalingVec=Vectors.dense([-1.0] * width), inputCol=ASSEMBLED, outputCol="__negated")
        both = assembled.unionByName(negate.transform(assembled).select(F.col("__negated").alias(ASSEMBLED)))
        model = PCA(k=k, inputCol=ASSEMBLED, outputCol="__scores").fit(both)
    else:
        vectors, values, _ = right_singular(assembled, ASSEMBLED, k, width)
        model = projection(vectors, values, ASSEMBLED, "__scores")
    stages = [model, _flip_stage(_signs(model.pc), "__scores")]
    scored = PipelineModel(stages).transform(assembled)
    row = scored.select(
        Summarizer.variance(F.col(FEATURES)).alias("kept"), Summarizer.variance(F.col(ASSEMBLED)).alias("all")
    ).first()
    total = float(sum(row["all"])) or 1.0
    return stages, [float(v) / total for v in row["kept"]]


def expand_features(df: DataFrame, names: list[str], target: str | None = None) -> DataFrame:
    """Vector to named columns, target first; absent entries are zero."""
    values = vector_to_array(F.col(FEATURES))
    cols = [values[i].alias(n) for i, n in enumerate(names)]
    return df.select(*([target] if target else []), *cols)


def density(df: DataFrame) -> DataFrame:
    """Set entries and width of the feature vectors, for checks."""
    values = vector_to_array(F.col(FEATURES))
    return df.agg(
        F.sum(F.size(F.filter(values, lambda x: x != 0))).alias("set_entries"),
        F.max(F.size(values)).alias("width"),
    )


