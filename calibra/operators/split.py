"""Label index, stratified split, folds, sample weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.config import NULL_LABEL, TierPolicy, TrainPolicy
from calibra.functions.text import blank_to_null
from calibra.functions.types import is_numeric, require_columns
from calibra.operators.classes import (
    balanced_weight,
    class_tiers,
    percent_of,
)
from calibra.operators.ordering import sorted_index
from calibra.operators.ranking import HASH, cut_lists, cuts_passed, rank_cuts, with_hash
from calibra.session import materialize, small_side

LABEL = "label"


def class_sizes(df: DataFrame, target: str) -> tuple[DataFrame, int]:
    """Rows ``(target, count)``, written once, and the number of classes.

    The number decides whether per-class tables are broadcast.
    """
    sizes = materialize(df.groupBy(target).agg(F.count(F.lit(1)).alias("count")), "classes")
    return sizes, sizes.count()


def label_index(sizes: DataFrame, target: str) -> DataFrame:
    """Classes in sorted order with their index, by a range-partitioned sort."""
    index, _ = sorted_index(sizes, [target, *[c for c in sizes.columns if c != target]], LABEL)
    return index.select(*sizes.columns, F.col(LABEL).cast("int"))


def encode_target(df: DataFrame, target: str) -> DataFrame:
    """Add ``label``: sorted index for text, 0/1 for boolean, the value itself for numbers.

    Text is stripped first; a missing or blank text is a class of its own.
    """
    require_columns(df, [target], "target column")
    dtype = df.schema[target].dataType
    if is_numeric(dtype):
        return df.withColumn(LABEL, F.col(target).cast("int") if dtype.simpleString() == "boolean" else F.col(target))
    text = F.coalesce(blank_to_null(F.col(target)), F.lit(NULL_LABEL))
    return with_label(df.withColumn("__text", text), "__text").drop("__text")


def with_label(df: DataFrame, target: str, sizes: tuple[DataFrame, int] | None = None) -> DataFrame:
    """Add the sorted class index whatever the type of the target."""
    counted, number = sizes or class_sizes(df, target)
    index = label_index(counted, target).select(F.col(target).alias("__class"), LABEL)
    return df.join(small_side(index, number), F.col(target).eqNullSafe(F.col("__class"))).drop("__class")


def test_quotas(classes: DataFrame, target: str, test_size: float) -> DataFrame:
    """Test rows per class: ``ceil(n * size)`` in total, by largest remainder.

    The remainders are ranked by a range-partitioned sort of the classes.
    """
    total = classes.agg(F.sum("count")).scalar()
    want = F.ceil(total * F.lit(float(test_size)))
    exact = F.col("count").cast("double") * want / total  # the product exceeds a long
    base = classes.select(target, "count", F.floor(exact).alias("floor"), F.round(F.floor(exact) - exact, 9).alias("minus"))
    place, _ = sorted_index(base, ["minus", target, "count", "floor"], "place")
    rest = want - base.agg(F.sum("floor")).scalar()
    return place.select(target, "count", (F.col("floor") + (F.col("place") < rest).cast("long")).alias("quota"))


def lite_quotas(classes: DataFrame, target: str, test_size: float) -> DataFrame:
    """Test rows per class on its own: ``max(1, round(n * size))``, half to even."""
    return classes.select(
        target,
        "count",
        F.greatest(F.lit(1), F.bround(F.col("count") * F.lit(float(test_size)), 0)).cast("long").alias("quota"),
    )


def _split_by_quota(
    df: DataFrame, target: str, keys: list[str], quotas: DataFrame, seed: int, bound: float | None, largest: int
) -> DataFrame:
    hashed = with_hash(df, seed, keys)
    wanted = quotas.filter("quota > 0").select(target, F.col("quota").alias("rank"))
    cuts = rank_cuts(hashed, target, wanted, bound, largest=largest).select(F.col(target).alias("__by"), "cut")
    joined = hashed.join(small_side(cuts, bound), F.col(target) == F.col("__by"), "left")
    is_test = F.coalesce(F.col(HASH) <= F.col("cut"), F.lit(False))
    return joined.withColumn("is_test", is_test).drop(HASH, "__by", "cut")


def stratified_split(
    df: DataFrame, target: str, keys: list[str], test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``is_test``: exact class shares, chosen by hash order of the row key."""
    sizes, number = class_sizes(df, target)
    return _split_by_quota(df, target, keys, test_quotas(sizes, target, test_size), seed, number, largest_class(sizes))


def lite_split(df: DataFrame, target: str, keys: list[str], test_size: float = 0.2, seed: int = 42) -> DataFrame:
    sizes, number = class_sizes(df, target)
    return _split_by_quota(df, target, keys, lite_quotas(sizes, target, test_size), seed, number, largest_class(sizes))


def largest_class(sizes: DataFrame) -> int:
    return int(sizes.agg(F.max("count").alias("m")).first()["m"] or 0)


def fold_count(folds: int, smallest_class: int) -> int:
    return max(2, min(folds, smallest_class))


def smallest_class(sizes: DataFrame) -> int:
    return int(sizes.agg(F.min("count").alias("m")).first()["m"] or 0)


def kfold(
    df: DataFrame, target: str, keys: list[str], folds: int = 5, seed: int = 42,
    sizes: tuple[DataFrame, int] | None = None,
) -> DataFrame:
    """Add ``fold`` (0-based): each class is cut into ``folds`` runs of its hash
    order whose sizes differ by at most one (larger runs first)."""
    counted, number = sizes or class_sizes(df, target)
    hashed = with_hash(df, seed, keys)
    size, extra = F.floor(F.col("count") / folds), F.col("count") % folds
    ends = F.transform(
        F.sequence(F.lit(1), F.lit(folds - 1)), lambda i: i * size + F.least(i.cast("long"), extra)
    )
    wanted = counted.select(target, F.explode(F.array_distinct(ends)).alias("rank")).filter("rank > 0")
    cuts = rank_cuts(hashed, target, wanted, number * folds, largest=largest_class(counted))
    lists = cut_lists(cuts, target)
    joined = hashed.join(small_side(lists, number), F.col(target) == F.col("__by"), "left")
    return joined.withColumn("fold", cuts_passed(F.col("cuts"))).drop(HASH, "__by", "cuts")


def sample_weights(df: DataFrame, target: str, sizes: tuple[DataFrame, int] | None = None) -> DataFrame:
    """Add ``weight``: balanced, unrounded, over the rows given; null is a class."""
    counted, number = sizes or class_sizes(df, target)
    sums = counted.agg(F.struct(F.sum("count").alias("total"), F.count(F.lit(1)).alias("k")).alias("s")).scalar()
    table = counted.select(
        F.col(target).alias("__class"),
        balanced_weight(sums.getField("total"), sums.getField("k"), F.col("count")).alias("weight"),
    )
    return df.join(small_side(table, number), F.col(target).eqNullSafe(F.col("__class"))).drop("__class")


def class_table(df: DataFrame, policy: TrainPolicy) -> DataFrame:
    """Training classes ``(target, count, label, quota)`` after both filters, written once.

    Later plans read it and do not count the classes again.
    """
    require_columns(df, [policy.target], "target column")
    target = policy.target
    counts = df.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("count"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    kept = materialize(counts.filter(percent_of(F.col("count"), total) >= policy.min_percentage), "classes")
    if kept.isEmpty():
        raise ValueError(f"no class reaches the minimum share of {policy.min_percentage}%")
    kept = kept.filter(F.col("count") >= policy.min_class_count)
    if kept.isEmpty():
        raise ValueError("no class has enough rows for a stratified split")
    labels = label_index(kept.select(target), target)
    return materialize(test_quotas(kept, target, policy.test_size).join(labels, target), "classes")


def prepare_split(df: DataFrame, policy: TrainPolicy, keys: list[str], classes: DataFrame | None = None) -> DataFrame:
    """Share filter, count filter, label index and stratified split in one frame."""
    target = policy.target
    classes = classes if classes is not None else class_table(df, policy)
    bound, largest = classes.agg(F.count(F.lit(1)), F.max("count")).first()
    index = classes.select(F.col(target).alias("__class"), LABEL)
    kept = df.join(small_side(index, bound), F.col(target) == F.col("__class")).drop("__class")
    return _split_by_quota(kept, target, keys, classes, policy.seed, bound, largest or 0)


def split_metadata(df: DataFrame, policy: TrainPolicy) -> DataFrame:
    """Counters of the two-stage filter, from the per-class counts alone."""
    tiers = TierPolicy(min_percentage=policy.min_percentage)
    by_share = F.col("percentage") >= policy.min_percentage
    by_both = by_share & (F.col("count") >= policy.min_class_count)

    def rows(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("count"))), F.lit(0))

    out = class_tiers(df, policy.target, tiers).agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("original_rows"),
        F.count(F.lit(1)).alias("original_class_count"),
        rows(by_share).alias("rows_after_percentage_filter"),
        F.count(F.when(by_share, 1)).alias("class_count_after_percentage_filter"),
        rows(by_both).alias("training_rows"),
        F.count(F.when(by_both, 1)).alias("training_class_count"),
    )
    return out.select(
        F.lit(float(policy.min_percentage)).alias("min_class_percentage"),
        F.lit(policy.min_class_count).alias("min_class_count"),
        *out.columns,
        (F.col("original_rows") - F.col("training_rows")).alias("removed_rows"),
        percent_of(F.col("training_rows"), F.col("original_rows")).alias("training_percentage"),
    )
