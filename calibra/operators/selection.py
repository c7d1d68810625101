"""Cross-validation, parameter search, champion election, phase gate."""

from __future__ import annotations

import random
from dataclasses import asdict, dataclass, field
from math import prod

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.config import NO_RESAMPLING
from calibra.operators.features import FEATURES
from calibra.operators.metrics import auc_summary, classification_metrics
from calibra.operators.resample import normalize_strategy, resample
from calibra.operators.split import LABEL, class_sizes, fold_count, kfold, sample_weights, smallest_class
from calibra.operators.training import ClassifierSpec, FittedClassifier, fit_classifier, to_vector

LOW_METRIC = 0.70  # fixed value: limit of the phase gate

# Search spaces per algorithm.
SEARCH_SPACES: dict[str, dict[str, list]] = {
    "gbt": {
        "maxDepth": [3, 4, 6, 8, 10],
        "maxIter": [200, 400, 600, 900, 1200],
        "stepSize": [0.01, 0.03, 0.05, 0.08, 0.1],
        "minInstancesPerNode": [1, 3, 5, 7],
        "subsamplingRate": [0.6, 0.7, 0.8, 0.9, 1.0],
    },
    "gbt_balanced": {
        "maxDepth": [4, 6, 8, 10],
        "maxIter": [300, 500, 800, 1200],
        "stepSize": [0.01, 0.03, 0.05, 0.08, 0.1],
    },
}


def resampled_rows(train: DataFrame, strategy: str, key: str, seed: int = 42) -> DataFrame:
    """The training rows ``(label, features)`` after the strategy."""
    plain = train.select(key, LABEL, vector_to_array(FEATURES).alias(FEATURES))
    return to_vector(resample(plain, strategy, LABEL, key, FEATURES, seed))


def train_on(
    spec: ClassifierSpec, train: DataFrame, strategy: str | None, key: str, weighted: bool, seed: int = 42,
    resampled: DataFrame | None = None,
) -> FittedClassifier:
    """Resample (training rows only), weight when asked and not resampled, fit.

    ``resampled`` has the rows after the strategy where they are there already.
    """
    name = normalize_strategy(strategy)
    if name is None:
        rows = train.select(key, LABEL, FEATURES)
        if weighted:
            rows = sample_weights(rows, LABEL)
        return fit_classifier(spec, rows, "weight" if weighted else None, key)
    return fit_classifier(spec, resampled_rows(train, name, key, seed) if resampled is None else resampled)


@dataclass(frozen=True)
class FoldScores:
    folds_used: int
    scores: dict[str, list[float | None]]

    def summary(self) -> dict[str, object]:
        """Mean and population deviation per metric."""
        out: dict[str, object] = {"cv_folds_used": self.folds_used}
        for name, values in self.scores.items():
            seen = [v for v in values if v is not None]
            mean = sum(seen) / len(seen) if seen else None
            std = (sum((v - mean) ** 2 for v in seen) / len(seen)) ** 0.5 if seen else None
            out[name] = {"mean": mean, "std": std, "folds": values}
        return out


def cross_validate(
    spec: ClassifierSpec, df: DataFrame, key: str, folds: int = 5, strategy: str | None = None, seed: int = 42,
    with_auc: bool = True,
) -> FoldScores:
    """Stratified folds; resampling happens inside each fold's training part."""
    sizes = class_sizes(df, LABEL)
    used = fold_count(folds, smallest_class(sizes[0]))
    folded = kfold(df, LABEL, [key], used, seed, sizes).persist()
    scores: dict[str, list[float | None]] = {"f1_macro": [], "recall_macro": []}
    if with_auc:
        scores["roc_auc_macro"] = []
    try:
        for i in range(used):
            model = train_on(spec, folded.filter(F.col("fold") != i), strategy, key, False, seed)
            held = model.transform(folded.filter(F.col("fold") == i), key).persist()
            row = classification_metrics(held, LABEL, "prediction", average="macro").first()
            scores["f1_macro"].append(row["f1"])
            scores["recall_macro"].append(row["recall"])
            if with_auc:
                auc = auc_summary(held, LABEL, "probability", list(range(spec.n_classes))).first()
                scores["roc_auc_macro"].append(auc["roc_auc"])
            held.unpersist()
    finally:
        folded.unpersist()
    return FoldScores(used, scores)


def sample_parameters(space: dict[str, list], count: int, seed: int = 42) -> list[dict[str, object]]:
    """Distinct random combinations of the grid, the same for the same seed."""
    size = prod(len(v) for v in space.values())
    picks = random.Random(seed).sample(range(size), min(count, size))
    combos = []
    for index in picks:
        combo = {}
        for name, values in space.items():
            index, at = divmod(index, len(values))
            combo[name] = values[at]
        combos.append(combo)
    return combos


@dataclass(frozen=True)
class SearchResult:
    algorithm: str
    best_params: dict[str, object]
    best_score: float
    scoring: str
    cv_folds: int
    n_iter: int
    trials: list[tuple[dict[str, object], float]] = field(default_factory=list)

    def as_dict(self) -> dict[str, object]:
        return asdict(self)


def search_parameters(
    spec: ClassifierSpec, train: DataFrame, key: str, n_iter: int = 15, folds: int = 3, scoring: str = "f1_macro",
    seed: int = 42, space: dict[str, list] | None = None,
) -> tuple[ClassifierSpec, SearchResult]:
    """Random search by cross-validation; returns the tuned spec, first best wins."""
    space = space or SEARCH_SPACES.get(spec.name)
    if not space:
        raise ValueError(f"no search space for {spec.name!r}; known: {', '.join(SEARCH_SPACES)}")
    trials = []
    used = folds
    for combo in sample_parameters(space, n_iter, seed):
        candidate = ClassifierSpec(spec.name, {**spec.params, **combo}, spec.n_classes, spec.seed)
        result = cross_validate(candidate, train, key, folds, None, seed, with_auc=scoring == "roc_auc_macro")
        used = result.folds_used
        trials.append((combo, result.summary()[scoring]["mean"] or 0.0))
    best, score = max(trials, key=lambda t: t[1])
    tuned = ClassifierSpec(spec.name, {**spec.params, **best}, spec.n_classes, spec.seed)
    return tuned, SearchResult(spec.name, best, score, scoring, used, len(trials), trials)


def champion(results: DataFrame, order: str, f1: str = "f1") -> DataFrame:
    """The row with the highest F1 (missing counts as zero), the first among equals."""
    return results.orderBy(F.coalesce(F.col(f1), F.lit(0.0)).desc(), order).limit(1)


def phase_gate(results: DataFrame, limit: float = LOW_METRIC) -> DataFrame:
    """Worst recall, F1 and AUC over the runs without resampling (all runs if none).

    ``run_next_phase`` is true when any of them is below the limit; a figure
    that is missing everywhere counts as zero.
    """
    plain = F.coalesce(F.col("resampling"), F.lit(NO_RESAMPLING)) == NO_RESAMPLING

    def worst(name: str) -> Column:
        return F.coalesce(F.min(F.when(plain, F.col(name))), F.when(F.max(plain.cast("int")) == 1, None).otherwise(F.min(name)), F.lit(0.0))

    out = results.agg(
        worst("recall").alias("recall_min"), worst("f1").alias("f1_min"), worst("roc_auc").alias("roc_auc_min")
    )
    low = (F.col("recall_min") < limit) | (F.col("f1_min") < limit) | (F.col("roc_auc_min") < limit)
    return out.withColumn("run_next_phase", low)
