"""Classification run: split, grid of algorithms and resampling, report, champion."""

from __future__ import annotations

from contextlib import ExitStack
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.config import DEFAULT_TIERS, NO_RESAMPLING, TierPolicy, TrainPolicy
from calibra.operators.classes import class_tiers
from calibra.operators.features import FEATURES
from calibra.operators.metrics import evaluate, per_class_metrics, with_labels_and_tiers
from calibra.operators.resample import normalize_strategy
from calibra.operators.selection import (
    SEARCH_SPACES,
    champion,
    cross_validate,
    phase_gate,
    resampled_rows,
    search_parameters,
    train_on,
)
from calibra.operators.split import LABEL, class_table, prepare_split, split_metadata
from calibra.operators.training import ClassifierSpec, FittedClassifier, build_registry, for_rounds
from calibra.session import materialize
from calibra.sources.artifacts import CHAMPION, save_model, stem, write_report
from calibra.sources.tables import path_exists

FITS = 4  # fits of an algorithm at the same time

SUMMARY = (
    "seq int, algorithm string, resampling string, accuracy double, precision double, recall double, f1 double, "
    "roc_auc double, pr_auc double, average string, multiclass boolean"
)


@dataclass
class RunResult:
    algorithm: str
    resampling: str | None
    metrics: dict
    per_class: list[dict]
    model: FittedClassifier | None = None
    cross_validation: dict | None = None
    search: dict | None = None


@dataclass
class TrainResult:
    results: list[RunResult]
    summary: DataFrame
    classes: list[str]
    split: dict
    compiled: list[str] = field(default_factory=list)
    champion: str | None = None


def summary_frame(spark, results: list[RunResult]) -> DataFrame:
    rows = [
        (
            i,
            r.algorithm,
            r.resampling or NO_RESAMPLING,
            *[r.metrics.get(k) for k in ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "average", "multiclass")],
        )
        for i, r in enumerate(results)
    ]
    return spark.createDataFrame(rows, SUMMARY)


def run_training(
    prepared: DataFrame, policy: TrainPolicy, key: str, path: str | None = None, tiers: TierPolicy = DEFAULT_TIERS,
    feature_names: list[str] | None = None,
) -> TrainResult:
    """Train every algorithm with every resampling strategy and compare them.

    ``prepared`` has a row key, the target and a ``features`` vector. The split
    is written once; all fits, folds and scores read it. The rows of a resampling
    strategy are made once for all algorithms; the strategies of an algorithm are
    fitted at the same time. Unknown algorithms are skipped.
    With ``path`` the report, each model and the champion are saved.
    """
    spark = prepared.sparkSession
    target = policy.target
    classes = class_table(prepared, policy)
    labels = [str(r[target]) for r in classes.orderBy(LABEL).collect()]
    source = prepared.select(key, target, FEATURES)
    split = materialize(prepare_split(source, policy, [key], classes), "split")
    train, test = split.filter(~F.col("is_test")), split.filter("is_test")
    registry = build_registry(policy.seed, len(labels), {a: policy.params_for(a) for a in policy.algorithms})
    names = spark.createDataFrame(list(enumerate(labels)), "class int, original_class string")
    after = class_tiers(split, target, tiers).select("class", "tier")
    results: list[RunResult] = []
    made: dict[str, DataFrame] = {}

    def run_one(spec: ClassifierSpec, strategy: str | None, search: dict | None) -> RunResult:
        weighted = strategy is None and spec.name != "knn"
        rows = for_rounds(spec, made.get(strategy, train))
        model = train_on(spec, rows, strategy, key, weighted, policy.seed, rows)
        scored = model.transform(test, key).select(LABEL, "prediction", "probability").persist()
        ids = list(range(len(labels)))
        metrics = evaluate(scored, LABEL, "prediction", "probability", ids)
        table = with_labels_and_tiers(per_class_metrics(scored, LABEL, "prediction", ids), names, after, tiers)
        per_class = [r.asDict() for r in table.collect()]
        scored.unpersist()
        folds = None
        if policy.cross_validate:
            folds = cross_validate(spec, split.drop("is_test"), key, policy.cv_folds, strategy, policy.seed).summary()
        return RunResult(spec.name, strategy, metrics, per_class, model, folds, search)

    with ExitStack() as held:
        for algorithm in policy.algorithms:
            spec = registry.get(algorithm)
            if spec is None:
                continue
            search = None
            if policy.search and algorithm in SEARCH_SPACES:
                spec, found = search_parameters(
                    spec, train, key, policy.search_iterations, policy.search_folds, policy.search_scoring, policy.seed
                )
                search = found.as_dict()
            strategies = [normalize_strategy(s) for s in policy.resampling]
            for strategy in strategies:
                if strategy is not None and strategy not in made:
                    made[strategy] = resampled_rows(train, strategy, key, policy.seed).persist()
                    held.callback(made[strategy].unpersist)
            cells = [(spec, strategy, search) for strategy in strategies]
            # boosting waits for many short jobs, not for cores, so the strategies share its time
            with ThreadPool(max(1, min(len(cells), FITS))) as pool:
                results += pool.starmap(inheritable_thread_target(spark)(run_one), cells)
    summary = summary_frame(spark, results)
    out = TrainResult(results, summary, labels, split_metadata(prepared, policy).first().asDict())
    if path is not None and results:
        write_report(summary, report(out, policy), f"{path}/report")
        registry = f"{path}/registry"  # written by the preparation under the same path
        compile_models(out, spark, f"{path}/compiled", tiers, feature_names, registry if path_exists(spark, registry) else None)
    return out


def report(result: TrainResult, policy: TrainPolicy) -> dict:
    return {
        "target_column": policy.target,
        "test_size": policy.test_size,
        "random_state": policy.seed,
        "resampling_strategies": [s or NO_RESAMPLING for s in policy.resampling],
        "cross_validation_enabled": policy.cross_validate,
        "cross_validation_folds": policy.cv_folds,
        "hyperparameter_search_enabled": policy.search,
        "split": {**result.split, "target_label_mapping": {c: i for i, c in enumerate(result.classes)}},
        "results": [
            {
                "algorithm": r.algorithm,
                "resampling": r.resampling or NO_RESAMPLING,
                **r.metrics,
                "cross_validation": r.cross_validation,
                "hyperparameter_search": r.search,
                "per_class": r.per_class,
            }
            for r in result.results
        ],
    }


def compile_models(
    result: TrainResult, spark, root: str, tiers: TierPolicy = DEFAULT_TIERS, feature_names: list[str] | None = None,
    registry_path: str | None = None,
) -> None:
    """Save each trained model and a copy of the champion; runs without a model are skipped.

    The metadata name the class-weight registry the run belongs to, if any.
    """
    trained = [r for r in result.results if r.model is not None]
    if not trained:
        return

    def metadata(r: RunResult) -> dict:
        numbers = {k: v for k, v in r.metrics.items() if isinstance(v, float)}
        return {
            "feature_columns": feature_names or [],
            "target_classes": result.classes,
            "metrics": numbers,
            "tier_thresholds": dict(tiers.thresholds),
            "class_weight_registry_path": registry_path,
        }

    for r in trained:
        result.compiled.append(save_model(r.model, spark, root, r.resampling, metadata(r)))
    first = champion(summary_frame(spark, trained), "seq").first()
    best = trained[first["seq"]]
    origin = {"champion_of": {"algorithm": best.algorithm, "resampling": best.resampling or NO_RESAMPLING}}
    save_model(best.model, spark, root, best.resampling, {**metadata(best), **origin}, CHAMPION)
    result.champion = stem(best.algorithm, best.resampling)


def console_rows(result: TrainResult) -> list[str]:
    """Report lines: the metrics of each run, then its classes below tier A."""
    text = lambda v: "n/a" if v is None else f"{v:.4f}"
    lines = []
    for r in result.results:
        m = r.metrics
        figures = " ".join(f"{k}={text(m[k])}" for k in ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc"))
        lines.append(f"{r.algorithm} (resampling={r.resampling or NO_RESAMPLING}) {figures}")
        for c in r.per_class:
            if c["tier"] != "A":
                lines.append(
                    f"  class={c['original_class']} (tier {c['tier']}, n={c['support']}) "
                    f"precision={c['precision']:.3f} recall={c['recall']:.3f} f1={c['f1']:.3f}"
                )
    return lines


# --- presets -----------------------------------------------------------------


def ordered_unique(names: list[str]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(names))


def compile_policy(
    target: str, algorithms: list[str] | None = None, include_balanced: bool = False,
    resampling: list[str] | None = None, **options,
) -> TrainPolicy:
    """Settings of a compile run from loose flags."""
    order = ordered_unique(algorithms) if algorithms else (("gbt_balanced", "gbt") if include_balanced else ("gbt",))
    chosen = ("smote",) if resampling is None else tuple(normalize_strategy(s) for s in resampling)
    return TrainPolicy(target=target, algorithms=order, resampling=chosen, **options)


def first_phase(target: str, **options) -> TrainPolicy:
    """Both boosted variants with parameter search, no resampling."""
    return TrainPolicy(target=target, algorithms=("gbt_balanced", "gbt"), resampling=(None,), search=True, **options)


def second_phase(target: str, **options) -> TrainPolicy:
    """Both boosted variants over all resampling strategies with folds."""
    return TrainPolicy(
        target=target, algorithms=("gbt_balanced", "gbt"), resampling=(None, "smote", "adasyn"), cross_validate=True,
        **options,
    )


def six_combinations(target: str, **options) -> TrainPolicy:
    return TrainPolicy(
        target=target, algorithms=("gbt_balanced", "gbt"), resampling=(None, "smote", "adasyn"), **options
    )


def run_two_phases(prepared: DataFrame, key: str, first: TrainPolicy, second: TrainPolicy) -> dict:
    """Phase two runs only when a figure of phase one is below the limit."""
    one = run_training(prepared, first, key)
    gate = phase_gate(one.summary).first().asDict()
    two = run_training(prepared, second, key) if gate["run_next_phase"] else None
    return {"gate": gate, "first": one, "second": two}
