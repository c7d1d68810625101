"""Scoring of validated records, in batches or single."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibra.config import DEFAULT_REVIEW, DEFAULT_TIERS, ReviewPolicy, TierPolicy
from calibra.operators.classes import retained_bound
from calibra.operators.glossary import load_glossary
from calibra.operators.history import append_history
from calibra.operators.review import merge_reviews, review_context, review_gate
from calibra.operators.score import HIGH_CONFIDENCE, add_results, decode_label, enrich, proba_pairs, response
from calibra.operators.training import FittedClassifier
from calibra.operators.validate import validate_batch
from calibra.sources.artifacts import CHAMPION, LoadedFeatures, load_features, load_model, read_json
from calibra.sources.tables import LINE, path_exists, read_csv_batch

REGISTRY_SCHEMA = "class string, count bigint, percentage double, tier string, weight double"


@dataclass(frozen=True)
class Scorer:
    """Everything one scoring job needs, loaded once."""

    features: LoadedFeatures
    model: FittedClassifier
    classes: list[str]
    registry: DataFrame
    glossary: DataFrame
    columns: tuple[str, ...]
    number: str
    glossary_rows: int | None = None
    glossary_status: str = "confirmado"
    policy: TierPolicy = DEFAULT_TIERS
    limit: float = HIGH_CONFIDENCE

    def score(self, records: DataFrame, key: str | None = None) -> DataFrame:
        """All result columns for typed records; full and feature-only records
        give the same result, since only the feature columns are read."""
        missing = [c for c in self.columns if c not in records.columns]
        if missing:
            raise ValueError(f"records lack feature columns: {', '.join(missing)}")
        ready = self.features.transform(records).select(*records.columns, "features")
        scored = self.model.transform(ready, key)
        out = decode_label(scored, self.classes)
        labels = F.array(*[F.lit(c) for c in self.classes])
        out = out.withColumn("predict_proba", proba_pairs(labels, F.col("probability")))
        number = F.col(self.number).cast("string") if self.number in records.columns else F.lit(None).cast("string")
        out = out.withColumn("numero_laudo", number).drop("features", "prediction", "probability")
        bound = retained_bound(self.policy.min_percentage)
        return enrich(add_results(out, self.registry, self.limit, self.policy, bound), self.glossary, self.glossary_rows)


def load_scorer(
    spark: SparkSession, root: str, columns: tuple[str, ...], number: str, limit: float = HIGH_CONFIDENCE,
    policy: TierPolicy = DEFAULT_TIERS,
) -> Scorer:
    """Load champion, feature stages, registry and glossary under ``root``.

    All missing artefacts are named in one error; only the glossary may be absent.
    """
    needed = [f"{root}/compiled/{CHAMPION}", f"{root}/features/stages", f"{root}/registry"]
    missing = [p for p in needed if not path_exists(spark, p)]
    if missing:
        raise ValueError(f"missing scoring artefacts: {'; '.join(missing)}")
    model, metadata = load_model(spark, f"{root}/compiled")
    classes = [str(c) for c in metadata.get("target_classes") or []]
    if not classes:
        raise ValueError("the champion's metadata lists no target classes")
    document = read_json(spark, f"{root}/registry") or {}
    rows = [
        (str(c["class"]), c.get("count"), c.get("percentage"), c.get("tier", policy.discard_label), c.get("weight"))
        for c in document.get("classes", [])
    ]
    glossary, status = load_glossary(spark, f"{root}/glossary")
    return Scorer(
        load_features(f"{root}/features"), model, classes, spark.createDataFrame(rows, REGISTRY_SCHEMA), glossary,
        columns, number, glossary.count(), status, policy, limit,
    )


def score_csv(scorer: Scorer, path: str, contract: T.StructType) -> DataFrame:
    """CSV batch to response rows with line numbers; never reviewed, never stored."""
    lines = read_csv_batch(scorer.registry.sparkSession, path)
    valid = validate_batch(lines, contract, LINE)
    return response(scorer.score(valid, LINE), (LINE,))


def score_single(
    scorer: Scorer, records: DataFrame, key: str, history: str | None = None, user: str | None = None,
    reviews: DataFrame | None = None, class_metrics: DataFrame | None = None,
    review_policy: ReviewPolicy = DEFAULT_REVIEW, force: bool | None = None,
) -> DataFrame:
    """Scored records with their gate decision, external reviews and history.

    A review only counts where the gate asked for one.
    """
    scored = scorer.score(records, key)
    context = review_context(
        scored, scorer.glossary, class_metrics, scorer.glossary_status,
        class_bound=retained_bound(scorer.policy.min_percentage), glossary_bound=scorer.glossary_rows,
    )
    gated = review_gate(context, review_policy, force, scorer.policy.discard_label)
    if reviews is not None:
        asked = gated.filter("review.should_call").select(F.col(key).alias("__asked"))
        wanted = reviews.join(asked, F.col(key) == F.col("__asked"), "left_semi")
        gated = merge_reviews(gated, wanted, key)
    out = response(gated, (key,) if key not in ("numero_laudo",) else ())
    if history is not None:
        append_history(response(gated), history, user or "unknown")
    return out
