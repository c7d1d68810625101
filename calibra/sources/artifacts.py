"""Writing and reading run artefacts: tables, reports, models, catalogue."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.config import NO_RESAMPLING
from calibra.operators.features import FittedFeatures
from calibra.operators.training import FittedClassifier, load_classifier, save_classifier
from calibra.operators.wide import WideEncoder
from calibra.sources.tables import path_exists

CHAMPION = "champion"
METADATA_SCHEMA = (
    "algorithm string, resampling string, trained_at string, feature_columns array<string>, "
    "target_classes array<string>, metrics map<string,double>, tier_thresholds map<string,double>, "
    "class_weight_registry_path string, model_path string, "
    "champion_of struct<algorithm:string,resampling:string>"
)
REQUIRED_METADATA = (
    "algorithm",
    "resampling",
    "trained_at",
    "feature_columns",
    "target_classes",
    "metrics",
    "tier_thresholds",
    "class_weight_registry_path",
)


def now_text() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def write_json(spark: SparkSession, payload: dict, path: str) -> None:
    text = json.dumps(payload, ensure_ascii=False, default=str)
    spark.range(0, 1, 1, 1).select(F.lit(text).alias("value")).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict | None:
    """The document, or None when it is missing or unreadable."""
    if not path_exists(spark, path):
        return None
    try:
        return json.loads(spark.read.text(path).filter("value <> ''").first()["value"])
    except (TypeError, ValueError):
        return None


def write_prepared(df: DataFrame, target: str, path: str, metadata: dict | None = None) -> None:
    """Prepared table with the target first, and its metadata document."""
    order = [target] + [c for c in df.columns if c != target]
    df.select(*order).write.mode("overwrite").parquet(f"{path}/prepared")
    if metadata is not None:
        write_json(df.sparkSession, {"created_at": now_text(), **metadata}, f"{path}/metadata")


def write_distribution(stages: DataFrame, path: str) -> None:
    """Distribution artefacts by stage, as CSV and JSON."""
    small = stages.hint("rebalance", "stage")  # few files for few classes, no single task for many
    small.write.mode("overwrite").partitionBy("stage").option("header", True).csv(f"{path}/csv")
    small.write.mode("overwrite").partitionBy("stage").json(f"{path}/json")


def write_registry(document: DataFrame, path: str) -> None:
    document.write.mode("overwrite").text(path)


def write_report(summary: DataFrame, details: dict, path: str) -> None:
    """Summary CSV (one row per run) and details document."""
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/summary")
    write_json(summary.sparkSession, {"created_at": now_text(), **details}, f"{path}/details")


CLASS_METRICS_SCHEMA = "class string, precision double, recall double, f1 double, support bigint, tier string"


def load_class_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Per-class figures of the first run in a details document that has some.

    Keyed by the original label; empty when the document cannot be read.
    """
    document = read_json(spark, path) or {}
    runs = document.get("results") or document.get("models") or []
    table = next((r["per_class"] for r in runs if r.get("per_class")), [])
    rows = [
        (str(c["original_class"]), c.get("precision"), c.get("recall"), c.get("f1"), c.get("support"), c.get("tier"))
        for c in table
        if c.get("original_class") is not None
    ]
    return spark.createDataFrame(rows, CLASS_METRICS_SCHEMA)


def stem(algorithm: str, resampling: str | None) -> str:
    return f"{algorithm}_{resampling or NO_RESAMPLING}"


def save_features(fitted: FittedFeatures, spark: SparkSession, path: str) -> None:
    """Stages and what describes them; a wide encoder keeps its levels as a table."""
    fitted.model.write().overwrite().save(f"{path}/stages")
    info = {"names": fitted.names, "width": fitted.width, "method": fitted.method}
    if fitted.wide:
        fitted.wide.levels.write.mode("overwrite").parquet(f"{path}/levels")
        fitted.wide.names().write.mode("overwrite").parquet(f"{path}/feature_names")
        info["wide"] = fitted.wide.document()
        info["reduced"] = fitted.wide.weights is not None
        if info["reduced"]:
            fitted.wide.weights.write.mode("overwrite").parquet(f"{path}/weights")
    write_json(spark, info, f"{path}/info")


@dataclass(frozen=True)
class LoadedFeatures:
    """Saved feature stages, with the encoder before them when it is a wide one."""

    model: PipelineModel
    wide: WideEncoder | None

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.wide.transform(df) if self.wide else df)


def load_features(path: str) -> LoadedFeatures:
    model = PipelineModel.load(f"{path}/stages")
    spark = SparkSession.active()
    info = read_json(spark, f"{path}/info") or {}
    weights = f"{path}/weights" if info.get("reduced") else None
    document = info.get("wide")
    return LoadedFeatures(model, WideEncoder.restore(spark, document, f"{path}/levels", weights) if document else None)


def save_model(
    fitted: FittedClassifier, spark: SparkSession, root: str, resampling: str | None, metadata: dict,
    name: str | None = None,
) -> str:
    """Model and metadata under ``{root}/{algorithm}_{resampling}`` (or ``name``)."""
    path = f"{root}/{name or stem(fitted.spec.name, resampling)}"
    save_classifier(fitted, spark, f"{path}/model")
    payload = {
        "algorithm": fitted.spec.name,
        "resampling": resampling or NO_RESAMPLING,
        "trained_at": now_text(),
        "class_weight_registry_path": None,
        "tier_thresholds": None,
        "model_path": f"{path}/model",
        **metadata,
    }
    missing = [k for k in REQUIRED_METADATA if k not in payload]
    if missing:
        raise ValueError(f"model metadata lacks {', '.join(missing)}")
    write_json(spark, payload, f"{path}/metadata")
    return path


def load_model(spark: SparkSession, root: str, name: str = CHAMPION) -> tuple[FittedClassifier, dict]:
    metadata = read_json(spark, f"{root}/{name}/metadata")
    if metadata is None:
        raise ValueError(f"no model named {name} under {root}")
    return load_classifier(spark, f"{root}/{name}/model"), metadata


def model_catalog(spark: SparkSession, root: str) -> DataFrame:
    """One row per compiled model, champion first, others by name.

    Unreadable metadata is skipped. Without a champion every row carries a
    message; without any model there is one row with the message only.
    """
    schema = "stem string, role string, algorithm string, resampling string, trained_at string, metrics map<string,double>, feature_columns_count int, target_classes array<string>, message string"
    message = f"no compiled champion under {root}; run a training job first"
    if not path_exists(spark, root):
        return spark.createDataFrame([(None, None, None, None, None, None, None, None, message)], schema)
    lines = (
        spark.read.option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).text(root)
        .withColumn("path", F.col("_metadata.file_path"))
        .filter(F.col("path").rlike("/metadata/part-[^/]*$") & ~F.col("path").rlike("/model/|/stages/"))
    )
    parsed = lines.withColumn("m", F.from_json("value", METADATA_SCHEMA)).filter(F.col("m.algorithm").isNotNull())
    rows = parsed.select(
        F.regexp_extract("path", r"/([^/]+)/metadata/part-[^/]*$", 1).alias("stem"),
        "m.algorithm",
        "m.resampling",
        "m.trained_at",
        "m.metrics",
        F.nullif(F.size(F.coalesce("m.feature_columns", F.array().cast("array<string>"))), F.lit(0)).alias("feature_columns_count"),
        "m.target_classes",
    )
    rows = rows.withColumn("role", F.when(F.col("stem") == CHAMPION, F.lit(CHAMPION)).otherwise(F.lit("variant")))
    has = rows.agg(F.coalesce(F.bool_or(F.col("role") == CHAMPION), F.lit(False)).alias("has")).scalar()
    listed = rows.select(
        "stem", "role", "algorithm", "resampling", "trained_at", "metrics", "feature_columns_count", "target_classes",
        F.when(~has, F.lit(message)).alias("message"),
    )
    if listed.isEmpty():
        return spark.createDataFrame([(None, None, None, None, None, None, None, None, message)], schema)
    return listed.orderBy(F.col("role") != CHAMPION, "stem")
