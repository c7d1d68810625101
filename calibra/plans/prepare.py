"""Preparation of a raw table for training: the fixed order of all steps."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.config import DEFAULT_PROFILE, DEFAULT_TIERS, PreparePolicy, ProfilePolicy, TierPolicy, TrainPolicy
from calibra.operators.classes import (
    distribution_stages,
    purge_metadata,
    purge_rows,
    rare_classes,
    registry_document,
)
from calibra.operators.clean import (
    counts_from,
    dedup_rows,
    denied_columns,
    drop_constant_columns,
    drop_null_target,
    find_constant_columns,
    nan_to_null,
    normalize_strings,
    project_denylist,
)
from calibra.operators.explore import (
    box_by_class,
    correlation_matrix,
    drop_correlated_columns,
    exploration_metadata,
    histograms,
    scatter_bins,
)
from calibra.operators.features import FeatureGroups, FittedFeatures, expand_features, feature_groups, fit_features, impute_median, integer_codes
from calibra.functions.types import is_numeric, numeric_columns, require_columns, string_columns
from calibra.operators.profile import Profile, Recommendations, build_profile, recommend
from calibra.operators.split import encode_target, prepare_split
from calibra.session import materialize
from calibra.sources.artifacts import save_features, write_distribution, write_json, write_prepared, write_registry

LISTED_CLASSES = 200_000  # removed classes named in the metadata document itself


@dataclass(frozen=True)
class Selection:
    """Columns kept for training and why the others went."""

    heuristic: list[str]
    constant: list[str]
    correlated: list[str]
    kept: list[str]
    groups: FeatureGroups


@dataclass(frozen=True)
class Prepared:
    training: DataFrame
    cleaned: DataFrame
    distinct: DataFrame
    profile: Profile
    recommendations: Recommendations
    selection: Selection
    features: FittedFeatures | None = None
    dataset: DataFrame | None = None
    metadata: dict = field(default_factory=dict)


def select_columns(
    cleaned: DataFrame, training: DataFrame, target: str, policy: PreparePolicy, profile_policy: ProfilePolicy,
    keep: tuple[str, ...] = (),
) -> tuple[Profile, Recommendations, Selection]:
    """Heuristic, constant and correlation pruning, then the feature groups.

    The heuristics look at the unpurged table; a second look at the pruned
    training columns only decides which of them are scaled. ``keep`` names row
    keys that are carried along but are no features.
    """
    features_of = lambda df: df.drop(*keep)
    profile = build_profile(features_of(cleaned), profile_policy)
    rec = recommend(features_of(cleaned), target, profile_policy, profile)
    heuristic = [c for c in rec.drop if c in training.columns and c != target]
    frame = features_of(training).drop(*heuristic, target)
    frame, constant = drop_constant_columns(frame)
    frame, correlated = drop_correlated_columns(frame, policy.correlation_threshold)
    second = recommend(features_of(training).select(*frame.columns, target), target, profile_policy)
    groups = feature_groups(frame, second)
    return profile, rec, Selection(heuristic, constant, correlated, frame.columns, groups)


def prepare(
    df: DataFrame,
    target: str,
    keep: tuple[str, ...] = (),
    policy: PreparePolicy = PreparePolicy(),
    tiers: TierPolicy = DEFAULT_TIERS,
    profile_policy: ProfilePolicy = DEFAULT_PROFILE,
    transform: bool = True,
) -> Prepared:
    """Clean, qualify, purge, profile, prune, then fit and apply the features.

    The de-duplicated table is written once to the shared folder: every later
    step reads it, and none repeats the full-row de-duplication.
    """
    require_columns(df, [target], "target column")
    distinct = materialize(dedup_rows(normalize_strings(nan_to_null(df))), "distinct")
    cleaned = drop_null_target(distinct, target)
    training = purge_rows(cleaned, target, tiers) if policy.enable_purge else cleaned
    profile, rec, selection = select_columns(cleaned, training, target, policy, profile_policy, keep)
    if not transform:
        return Prepared(training, cleaned, distinct, profile, rec, selection)
    source = training
    if policy.fit_scope == "train":
        # The same rows that a later split with this key and seed trains on.
        if not keep:
            raise ValueError('fit_scope="train" needs a row key in keep')
        parts = prepare_split(training, TrainPolicy(target, min_percentage=tiers.min_percentage), [keep[0]])
        source = parts.filter(~F.col("is_test"))
    fitted = fit_features(source, selection.groups, policy)
    dataset = encode_target(fitted.transform(training), target).select(*keep, target, "label", "features")
    return Prepared(training, cleaned, distinct, profile, rec, selection, fitted, dataset)


def counts_of(df: DataFrame, done: Prepared, target: str) -> dict[str, int]:
    return counts_from(df, done.distinct, target).first().asDict()


def prepare_counts(
    df: DataFrame, target: str, policy: PreparePolicy = PreparePolicy(), tiers: TierPolicy = DEFAULT_TIERS,
    profile_policy: ProfilePolicy = DEFAULT_PROFILE, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Counters of a preparation as rows ``(metric, value)``."""
    spark = df.sparkSession
    done = prepare(df, target, keep, policy, tiers, profile_policy, transform=False)
    counts = counts_of(df, done, target)
    purge = purge_metadata(done.cleaned, target, tiers).first().asDict()
    s = done.selection
    rows = {
        **counts,
        "training_rows": purge["retained_rows"],
        "original_classes": purge["original_class_count"],
        "retained_classes": purge["retained_class_count"],
        "dropped_heuristic": len(s.heuristic),
        "dropped_constant": len(s.constant),
        "dropped_correlated": len(s.correlated),
        "retained_features": len(s.kept),
        "scaled_columns": len(s.groups.scaled),
        "categorical_columns": len(s.groups.categorical),
        "passthrough_columns": len(s.groups.passthrough),
    }
    return spark.createDataFrame([(k, int(v)) for k, v in rows.items()], "metric string, value bigint")


def describe(done: Prepared, df: DataFrame, target: str, tiers: TierPolicy, policy: PreparePolicy) -> dict:
    """The metadata document of a preparation."""
    f, s = done.features, done.selection
    purge = purge_metadata(done.cleaned, target, tiers).first().asDict()
    # All removed classes are in the table that run_preparation writes beside the document.
    listed = rare_classes(done.cleaned, target, tiers.min_percentage).limit(LISTED_CLASSES).collect()
    removed = [r.asDict() for r in listed]
    explained = list(f.explained) if f else []
    return {
        "target_column": target,
        **counts_of(df, done, target),
        "original_columns": len(df.columns),
        "class_purge": {"enabled": policy.enable_purge, **purge, "removed_classes": removed, "removed_classes_table": "removed_classes"},
        "dropped_columns": {
            "heuristic": s.heuristic,
            "constant": s.constant,
            "high_correlation": s.correlated,
        },
        "feature_groups": (f.groups if f else s.groups).as_dict(),
        "retained_feature_columns": s.kept,
        "output_feature_columns": f.names if f else [],
        "heuristic_recommendations": {
            "cols_to_drop": done.recommendations.drop,
            "cols_to_scale": done.recommendations.scale,
            "cols_to_encode": done.recommendations.encode,
        },
        "dataset_profile": done.profile.as_dict(),
        "dimensionality_reduction": {
            "enabled": bool(f and f.method),
            "method": f.method if f else None,
            "parameter": policy.components if policy.enable_reduction else None,
            "n_components": len(explained) if f and f.method else None,
            "explained_variance_ratio": explained,
            "explained_variance_ratio_sum": sum(explained) if explained else None,
        },
        "target": {"dtype": df.schema[target].dataType.simpleString()},
    }


def write_exploration(
    cleaned: DataFrame, target: str, path: str, deny_list: tuple[str, ...] = (), class_bound: float | None = None
) -> None:
    """Data of the exploration pages: roles, histograms, correlations, features by target.

    A numeric target gives binned scatter counts, any other target box figures.
    """
    roles = exploration_metadata(cleaned, target, deny_list)
    roles.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
    frame = cleaned.drop(*denied_columns(cleaned, deny_list, target))
    numeric = numeric_columns(frame, (target,))
    if not numeric:
        return
    histograms(frame, numeric).write.mode("overwrite").parquet(f"{path}/histograms")
    correlation_matrix(frame, numeric).write.mode("overwrite").parquet(f"{path}/correlations")
    if is_numeric(cleaned.schema[target].dataType) and cleaned.schema[target].dataType.simpleString() != "boolean":
        by_target = scatter_bins(frame, numeric, target)
    else:
        by_target = box_by_class(frame, numeric, target, class_bound)
    by_target.write.mode("overwrite").parquet(f"{path}/by_target")


def run_preparation(
    df: DataFrame, target: str, path: str, keep: tuple[str, ...] = (), policy: PreparePolicy = PreparePolicy(),
    tiers: TierPolicy = DEFAULT_TIERS, profile_policy: ProfilePolicy = DEFAULT_PROFILE, explore: bool = True,
) -> Prepared:
    """Prepare and write all artefacts under ``path``."""
    done = prepare(df, target, keep, policy, tiers, profile_policy)
    metadata = describe(done, df, target, tiers, policy)
    if done.features.names:
        write_prepared(expand_features(done.dataset, done.features.names, target), target, path, metadata)
    else:  # too wide for columns: the vectors below, and the names that save_features writes as a table
        write_json(df.sparkSession, metadata, f"{path}/metadata")
    done.dataset.write.mode("overwrite").parquet(f"{path}/vectors")
    write_distribution(distribution_stages(done.cleaned, target, tiers), f"{path}/distribution")
    rare_classes(done.cleaned, target, tiers.min_percentage).write.mode("overwrite").parquet(f"{path}/removed_classes")
    write_registry(registry_document(done.cleaned, target, tiers), f"{path}/registry")
    if explore:
        write_exploration(done.cleaned.drop(*keep), target, f"{path}/exploration", profile_policy.deny_list)
    save_features(done.features, df.sparkSession, f"{path}/features")
    write_json(df.sparkSession, metadata, f"{path}/summary")
    return replace(done, metadata=metadata)


def summary_rows(done: Prepared) -> list[tuple[str, str]]:
    """Counters of the console summary."""
    m = done.metadata
    rows = [
        ("target", m["target_column"]),
        ("original_rows", str(m["original_rows"])),
        ("cleaned_rows", str(m["cleaned_rows"])),
        ("dropped_heuristic", str(len(m["dropped_columns"]["heuristic"]))),
        ("dropped_constant", str(len(m["dropped_columns"]["constant"]))),
        ("dropped_correlated", str(len(m["dropped_columns"]["high_correlation"]))),
    ]
    purge = m["class_purge"]
    if purge["enabled"]:
        rows.append(("classes", f"{purge['original_class_count']} -> {purge['retained_class_count']}"))
    red = m["dimensionality_reduction"]
    if red["enabled"]:
        rows.append(("reduction", f"{red['method']} {red['n_components']} {red['explained_variance_ratio_sum']:.4f}"))
    return rows


def lite_prepare(
    df: DataFrame, target: str, deny_list: tuple[str, ...] = (), tiers: TierPolicy = DEFAULT_TIERS
) -> DataFrame:
    """Short preparation: purge, deny list, integer codes, medians, no constants."""
    rows = df.dropDuplicates().filter(F.col(target).isNotNull())
    kept = materialize(project_denylist(purge_rows(rows, target, tiers), deny_list, target), "lite")
    texts = [c for c in string_columns(kept) if c != target]
    coded = integer_codes(kept, texts)
    numeric = [c for c in numeric_columns(kept) if c != target]
    filled = impute_median(coded, numeric)
    features = [c for c in filled.columns if c != target]
    return filled.drop(*find_constant_columns(filled.select(*features)))
