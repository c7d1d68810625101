"""Classifiers on Spark ML with one interface: fit, score, save, load.

A fitted model adds ``prediction`` (class index) and ``probability`` (array in
class order) to a frame with a ``features`` vector.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.operators.features import FEATURES
from calibra.operators.neighbors import knn_classify
from calibra.operators.split import LABEL, sample_weights
from calibra.session import keep_checkpoints, materialize, scratch_path

DEFAULT_ORDER = ("gbt",)

# Default training settings of the boosted trees and of k-NN.
DEFAULT_PARAMS: dict[str, dict[str, object]] = {
    "gbt": {
        "maxDepth": 6,
        "maxIter": 500,
        "stepSize": 0.05,
        "minInstancesPerNode": 3,
        "subsamplingRate": 0.8,
        "featureSubsetStrategy": "0.8",
    },
    "gbt_balanced": {"maxDepth": 6, "maxIter": 600, "stepSize": 0.05},
    "rf": {"maxDepth": 6, "numTrees": 100},
    "logreg": {"maxIter": 100, "regParam": 0.01},
    "knn": {"k": 7},
}

_TREES = ("gbt", "gbt_balanced")

# Fixed value: numbers (rows times features) that a task of a boosting round reads at least; fewer do not pay for its start.
ROUND_VALUES = 1 << 20
_MODEL_CLASSES = {"rf": RandomForestClassificationModel, "logreg": LogisticRegressionModel}


@dataclass(frozen=True)
class ClassifierSpec:
    name: str
    params: dict[str, object]
    n_classes: int
    seed: int = 42


def build_registry(
    seed: int = 42, n_classes: int = 2, overrides: dict[str, dict[str, object]] | None = None
) -> dict[str, ClassifierSpec]:
    overrides = overrides or {}
    return {
        name: ClassifierSpec(name, {**params, **overrides.get(name, {})}, n_classes, seed)
        for name, params in DEFAULT_PARAMS.items()
    }


def _argmax(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


@dataclass(frozen=True)
class FittedClassifier:
    spec: ClassifierSpec
    models: list = field(default_factory=list)
    table: DataFrame | None = None  # training rows of the neighbour classifier

    def transform(self, df: DataFrame, key: str | None = None) -> DataFrame:
        if self.spec.name == "knn":
            return self._by_neighbors(df, key)
        if self.spec.name in _TREES:
            return self._by_trees(df)
        model = self.models[0].copy()
        model.setPredictionCol("__prediction").setProbabilityCol("__probability").setRawPredictionCol("__raw")
        probability = vector_to_array(F.col("__probability"))
        # A class missing from the training labels has no slot in the model.
        missing = F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(self.spec.n_classes) - F.size(probability)))
        return model.transform(df).select(
            *df.columns,
            F.col("__prediction").cast("int").alias("prediction"),
            F.concat(probability, missing).alias("probability"),
        )

    def _by_trees(self, df: DataFrame) -> DataFrame:
        out = df
        for i, model in enumerate(self.models):
            one = model.copy()
            one.setPredictionCol(f"__p{i}").setProbabilityCol(f"__s{i}").setRawPredictionCol(f"__r{i}")
            out = one.transform(out).drop(f"__p{i}", f"__r{i}")
        scores = [vector_to_array(F.col(f"__s{i}"))[1] for i in range(len(self.models))]
        if len(scores) == 1:
            raw = F.array(1 - scores[0], scores[0])
        else:
            raw = F.array(*scores)
        out = out.select(*df.columns, raw.alias("__raw"))
        total = F.aggregate("__raw", F.lit(0.0), lambda a, x: a + x)
        out = out.withColumn("probability", F.transform("__raw", lambda x: x / total))
        return out.select(*df.columns, _argmax(F.col("probability")).alias("prediction"), "probability")

    @staticmethod
    def _vote_share(label: int, found: Column) -> Column:
        own = F.filter("votes", lambda v: v["label"] == label)
        return F.coalesce(F.get(own, F.lit(0)).getField("votes") / found, F.lit(0.0))

    def _by_neighbors(self, df: DataFrame, key: str | None) -> DataFrame:
        if key is None:
            raise ValueError("the neighbour classifier needs the key column of the rows to score")
        k = int(self.spec.params["k"])
        # Row numbers keep training and scored keys apart in the join.
        rows = df.select(F.col(key).alias("__k"), vector_to_array(F.col(FEATURES)).alias("__v"))
        base = self.table.select(F.col("id").alias("__k"), F.col("values").alias("__v"), LABEL)
        voted = knn_classify(rows, base, "__k", "__v", LABEL, k)
        found = F.aggregate("votes", F.lit(0), lambda a, v: a + v["votes"])
        share = [self._vote_share(c, found) for c in range(self.spec.n_classes)]
        votes = voted.select(
            "__k", F.col("prediction").cast("int").alias("prediction"), F.array(*share).alias("probability")
        )
        return df.join(votes, F.col(key) == F.col("__k"), "left").drop("__k")


def _binary(train: DataFrame, label: int) -> DataFrame:
    return train.withColumn("__y", (F.col(LABEL) == label).cast("double"))


def for_rounds(spec: ClassifierSpec, train: DataFrame) -> DataFrame:
    """The same rows, for boosted trees in no more partitions than their number asks for.

    Each level of each tree is a job over all rows, so on a small table the
    start of tasks is most of the time.
    """
    first = train.select(FEATURES).dropna().first() if spec.name in _TREES else None
    if first is None:
        return train
    return train.coalesce(max(1, -(-train.count() * len(first[FEATURES]) // ROUND_VALUES)))


def _fit_trees(spec: ClassifierSpec, train: DataFrame, weight: str | None, parallelism: int) -> list:
    keep_checkpoints(train.sparkSession)
    params = dict(spec.params)
    options = {"weightCol": weight} if weight else {}
    classifier = GBTClassifier(
        labelCol="__y", featuresCol=FEATURES, seed=spec.seed, **{**params, **options}
    )
    targets = [1] if spec.n_classes <= 2 else list(range(spec.n_classes))

    def fit_one(label: int):
        return classifier.fit(_binary(train, label))

    if len(targets) == 1 or parallelism <= 1:
        return [fit_one(t) for t in targets]
    with ThreadPool(min(parallelism, len(targets))) as pool:
        return pool.map(inheritable_thread_target(train.sparkSession)(fit_one), targets)


def fit_classifier(
    spec: ClassifierSpec, train: DataFrame, weight: str | None = None, key: str | None = None, parallelism: int = 4
) -> FittedClassifier:
    """Fit on a frame with ``label`` (class index) and a ``features`` vector.

    Boosted trees are binary, so more than two classes are fitted one against
    the rest and the positive probabilities are normalised.
    """
    if spec.name == "knn":
        ids = F.col(key) if key else F.monotonically_increasing_id()
        rows = train.select(ids.alias("id"), vector_to_array(F.col(FEATURES)).alias("values"), LABEL)
        return FittedClassifier(spec, table=materialize(rows, "knn"))
    if spec.name == "gbt_balanced":
        train, weight = sample_weights(train.drop("weight"), LABEL), "weight"
    columns = [LABEL, FEATURES] + ([weight] if weight else [])
    train = train.select(*columns).persist()
    try:
        if spec.name in _TREES:
            return FittedClassifier(spec, _fit_trees(spec, train, weight, parallelism))
        options = {"weightCol": weight} if weight else {}
        params = {**spec.params, **options, "labelCol": LABEL, "featuresCol": FEATURES}
        if spec.name == "rf":
            model = RandomForestClassifier(seed=spec.seed, **params).fit(train)
        elif spec.name == "logreg":
            model = LogisticRegression(family="multinomial", **params).fit(train)
        else:
            raise ValueError(f"unknown algorithm {spec.name!r}; known: {', '.join(DEFAULT_PARAMS)}")
        return FittedClassifier(spec, [model])
    finally:
        train.unpersist()


def to_vector(df: DataFrame, vector: str = FEATURES) -> DataFrame:
    return df.withColumn(vector, array_to_vector(F.col(vector)))


# --- persistence -------------------------------------------------------------


def save_classifier(fitted: FittedClassifier, spark: SparkSession, path: str) -> None:
    spec = fitted.spec
    for i, model in enumerate(fitted.models):
        model.write().overwrite().save(f"{path}/model_{i}")
    if fitted.table is not None:
        fitted.table.write.mode("overwrite").parquet(f"{path}/table")
    text = json.dumps(
        {"name": spec.name, "params": spec.params, "n_classes": spec.n_classes, "seed": spec.seed, "models": len(fitted.models)}
    )
    spark.range(0, 1, 1, 1).select(F.lit(text).alias("value")).write.mode("overwrite").text(f"{path}/spec")


def load_classifier(spark: SparkSession, path: str) -> FittedClassifier:
    info = json.loads(spark.read.text(f"{path}/spec").filter("value <> ''").first()["value"])
    spec = ClassifierSpec(info["name"], info["params"], info["n_classes"], info["seed"])
    if spec.name == "knn":
        return FittedClassifier(spec, table=spark.read.parquet(f"{path}/table"))
    reader = GBTClassificationModel if spec.name in _TREES else _MODEL_CLASSES[spec.name]
    return FittedClassifier(spec, [reader.load(f"{path}/model_{i}") for i in range(info["models"])])


def temporary_model_path(spark: SparkSession) -> str:
    return scratch_path(spark, "model")
