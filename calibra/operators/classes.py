"""Class distribution, tiers, weights, registry and purge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.config import DEFAULT_TIERS, NULL_LABEL, TierPolicy
from calibra.functions.types import require_columns
from calibra.session import BROADCAST_ROW_BOUND, small_side


def class_label(df: DataFrame, target: str) -> Column:
    """Class as text; a missing target is a class of its own."""
    text = F.col(target).cast("string")
    if df.schema[target].dataType.simpleString() == "boolean":
        text = F.initcap(text)
    return F.coalesce(text, F.lit(NULL_LABEL))


def percent_of(part: Column, whole: Column) -> Column:
    return F.round(part / F.greatest(whole, F.lit(1)) * 100, 4)


def class_counts(df: DataFrame, target: str) -> DataFrame:
    require_columns(df, [target], "target column")
    return df.groupBy(class_label(df, target).alias("class")).agg(F.count(F.lit(1)).alias("count"))


def with_percentage(counts: DataFrame) -> DataFrame:
    # The total is a scalar subquery over the same counts, so no global window
    # gathers the classes and the counting shuffle is reused.
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total")).scalar()
    return counts.withColumn("percentage", percent_of(F.col("count"), total))


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """``class, count, percentage`` from the most to the least frequent class."""
    return with_percentage(class_counts(df, target)).orderBy(F.desc("count"), "class")


def tier_of(percentage: Column, policy: TierPolicy = DEFAULT_TIERS) -> Column:
    """Tier from the rounded percentage, highest limit first."""
    expr = None
    for tier, limit in policy.descending():
        hit = percentage >= F.lit(float(limit))
        expr = F.when(hit, F.lit(tier)) if expr is None else expr.when(hit, F.lit(tier))
    return F.lit(policy.discard_label) if expr is None else expr.otherwise(F.lit(policy.discard_label))


def class_tiers(df: DataFrame, target: str, policy: TierPolicy = DEFAULT_TIERS) -> DataFrame:
    return class_distribution(df, target).withColumn("tier", tier_of(F.col("percentage"), policy))


def balanced_weight(total: Column, classes: Column, count: Column) -> Column:
    return total / (classes * count)


def with_weights(distribution: DataFrame) -> DataFrame:
    """Balanced weight ``total / (classes * count)`` over the frame given."""
    sums = distribution.agg(
        F.struct(F.sum("count").alias("total"), F.count(F.lit(1)).alias("k")).alias("s")
    ).scalar()
    return distribution.withColumn(
        "weight",
        F.round(balanced_weight(sums.getField("total"), sums.getField("k"), F.col("count")), 6),
    )


def class_weights(df: DataFrame, target: str) -> DataFrame:
    return with_weights(class_distribution(df, target))


def rare_classes(df: DataFrame, target: str, min_percentage: float = DEFAULT_TIERS.min_percentage) -> DataFrame:
    return class_distribution(df, target).filter(F.col("percentage") < min_percentage)


def retained_bound(min_percentage: float) -> float | None:
    """Most classes that can reach a share: a proven size bound for broadcasts."""
    exact = min_percentage - 0.00005  # the rounded share may lie this much higher
    return 100.0 / exact + 1 if exact > 0 else None


def retained_classes(
    df: DataFrame, target: str, policy: TierPolicy = DEFAULT_TIERS, min_count: int = 0
) -> DataFrame:
    """Classes that reach the minimum share and count, with tier."""
    kept = class_tiers(df, target, policy).filter(F.col("percentage") >= policy.min_percentage)
    return kept.filter(F.col("count") >= min_count) if min_count > 0 else kept


def class_registry(df: DataFrame, target: str, policy: TierPolicy = DEFAULT_TIERS) -> DataFrame:
    """Registry rows of the retained classes; weights are over retained rows only."""
    return with_weights(retained_classes(df, target, policy))


def registry_discarded(df: DataFrame, target: str, policy: TierPolicy = DEFAULT_TIERS) -> DataFrame:
    gone = class_tiers(df, target, policy).filter(F.col("percentage") < policy.min_percentage)
    return gone.groupBy("tier").agg(
        F.count("class").alias("class_count"),
        F.sum("count").alias("total_rows"),
        F.round(F.sum("percentage"), 4).alias("total_percentage"),
    )


def _kept_and_lost(policy: TierPolicy) -> tuple[Column, Column]:
    kept = F.col("percentage") >= policy.min_percentage
    return kept, ~kept


def registry_summary(df: DataFrame, target: str, policy: TierPolicy = DEFAULT_TIERS) -> DataFrame:
    """Totals of the registry, all from the per-class counts."""
    kept, lost = _kept_and_lost(policy)
    return (
        class_tiers(df, target, policy)
        .agg(
            F.coalesce(F.sum("count"), F.lit(0)).alias("total_rows"),
            F.coalesce(F.sum(F.when(kept, F.col("count"))), F.lit(0)).alias("retained_rows"),
            F.count(F.when(kept, 1)).alias("retained_class_count"),
            F.count(F.when(lost, 1)).alias("discarded_class_count"),
        )
        .select(
            F.lit(target).alias("target_column"),
            F.lit(float(policy.min_percentage)).alias("min_class_percentage"),
            F.lit(policy.discard_label).alias("discard_tier_label"),
            "total_rows",
            "retained_rows",
            percent_of(F.col("retained_rows"), F.col("total_rows")).alias("retained_rows_percentage"),
            "retained_class_count",
            "discarded_class_count",
            (F.col("total_rows") - F.col("retained_rows")).alias("discarded_rows"),
        )
    )


def registry_document(df: DataFrame, target: str, policy: TierPolicy = DEFAULT_TIERS) -> DataFrame:
    """The registry as one JSON row, with its creation time.

    Only retained classes (at most ``100 / min_percentage``) and per-tier
    totals enter the document; without a share limit the classes are counted.
    """
    if retained_bound(policy.min_percentage) is None and class_counts(df, target).count() > BROADCAST_ROW_BOUND:
        raise ValueError(f"more than {BROADCAST_ROW_BOUND} classes; set a minimum percentage")
    rows = F.struct("class", "count", "percentage", "tier", "weight")
    classes = class_registry(df, target, policy).agg(F.sort_array(F.collect_list(
        F.struct((-F.col("count")).alias("o"), F.col("class").alias("c"), rows.alias("r"))
    )).alias("a")).select(F.transform("a", lambda x: x["r"]).alias("classes")).scalar()
    discarded = registry_discarded(df, target, policy).agg(F.sort_array(F.collect_list(
        F.struct("tier", "class_count", "total_rows", "total_percentage")
    )).alias("d")).scalar()
    summary = registry_summary(df, target, policy)
    return summary.select(
        F.to_json(
            F.struct(
                F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created_at"),
                *[F.col(c) for c in summary.columns],
                F.create_map(
                    *[x for name, limit in policy.thresholds for x in (F.lit(name), F.lit(limit))]
                ).alias("tier_thresholds"),
                classes.alias("classes"),
                discarded.alias("discarded_summary_by_tier"),
            )
        ).alias("value")
    )


def purge_rows(
    df: DataFrame, target: str, policy: TierPolicy = DEFAULT_TIERS, min_count: int = 0
) -> DataFrame:
    """Keep the rows of classes that reach the minimum share (and count).

    A semi join on the retained classes: at most ``100 / min_percentage`` of
    them exist, so the broadcast is bounded and the data is not shuffled.
    """
    if policy.min_percentage <= 0 and min_count <= 1:
        return df
    kept = retained_classes(df, target, policy, min_count).select(F.col("class").alias("__kept"))
    side = small_side(kept, retained_bound(policy.min_percentage))
    return df.join(side, class_label(df, target) == F.col("__kept"), "left_semi")


def min_count_filter(
    df: DataFrame, target: str, policy: TierPolicy = DEFAULT_TIERS, min_count: int = 2
) -> DataFrame:
    """Share filter, then the absolute-count safety net, as one semi join."""
    return purge_rows(df, target, policy, min_count)


def ensure_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def purge_metadata(df: DataFrame, target: str, policy: TierPolicy = DEFAULT_TIERS) -> DataFrame:
    """Counters of the purge; needs only the per-class counts, not the purged rows."""
    summary = registry_summary(df, target, policy)
    return summary.select(
        "min_class_percentage",
        F.col("total_rows").alias("original_rows"),
        "retained_rows",
        F.col("discarded_rows").alias("removed_rows"),
        "retained_rows_percentage",
        (F.col("retained_class_count") + F.col("discarded_class_count")).alias("original_class_count"),
        "retained_class_count",
        F.col("discarded_class_count").alias("removed_class_count"),
    )


def distribution_stages(df: DataFrame, target: str, policy: TierPolicy = DEFAULT_TIERS) -> DataFrame:
    """Tiered distribution before and after the purge, tagged by stage.

    The after-stage recomputes shares on the kept classes' counts; the rows
    themselves are read once.
    """
    before = class_tiers(df, target, policy)
    kept = before.filter(F.col("percentage") >= policy.min_percentage).select("class", "count")
    after = with_percentage(kept).withColumn("tier", tier_of(F.col("percentage"), policy))
    return before.withColumn("stage", F.lit("before_purge")).unionByName(
        after.withColumn("stage", F.lit("after_purge"))
    )
