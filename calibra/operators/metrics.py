"""Classification metrics as aggregates over (truth, prediction) counts and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibra.config import DEFAULT_TIERS, TierPolicy
from calibra.session import materialize, small_side

SLICE_ROWS = 200_000  # distinct scores that are sorted together


def confusion_counts(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("count")
    )


def confusion_matrix(df: DataFrame, truth: str, prediction: str, classes: list) -> DataFrame:
    """Dense matrix in long form: every pair of the given classes, zero when unseen."""
    counts = confusion_counts(df, truth, prediction)
    labels = F.array(*[F.lit(c) for c in classes])
    truths = df.sparkSession.range(1).select(F.explode(labels).alias("truth"))
    zeros = truths.select("truth", F.explode(labels).alias("prediction"), F.lit(0).cast("long").alias("count"))
    return counts.unionByName(zeros).groupBy("truth", "prediction").agg(F.sum("count").alias("count"))


def class_table(counts: DataFrame, classes: list | None = None) -> DataFrame:
    """Per class: support, predicted rows, hits and precision, recall, F1.

    Each confusion cell adds to its truth class and to its predicted class, so
    one grouping replaces a full outer join. Undefined ratios are zero. With
    ``classes`` the result has exactly those classes.
    """
    hit = F.when(F.col("truth") == F.col("prediction"), F.col("count")).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("truth").alias("class"), F.col("count").alias("support"), zero.alias("predicted"), hit.alias("hits")),
        F.struct(F.col("prediction").alias("class"), zero.alias("support"), F.col("count").alias("predicted"), zero.alias("hits")),
    )
    rows = counts.select(F.inline(sides))
    if classes is not None:
        grid = counts.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in classes])).alias("class"))
        grid = grid.select("class", zero.alias("support"), zero.alias("predicted"), zero.alias("hits"))
        rows = rows.filter(F.col("class").isin(list(classes))).unionByName(grid)
    sums = rows.groupBy("class").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    precision, recall = _ratio("hits", "predicted"), _ratio("hits", "support")
    with_ratios = sums.withColumn("precision", precision).withColumn("recall", recall)
    both = F.col("precision") + F.col("recall")
    return with_ratios.withColumn(
        "f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), both), F.lit(0.0))
    )


def _ratio(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))


def classification_metrics(
    df: DataFrame, truth: str, prediction: str, average: str | None = None, classes: list | None = None
) -> DataFrame:
    """One row: accuracy, precision, recall, F1, the averaging used, multiclass flag.

    More than two true labels give the macro mean over all labels seen in truth
    or prediction, otherwise the figures of label 1. ``classes`` fixes the label
    list of the macro mean.
    """
    counts = confusion_counts(df, truth, prediction)
    table = class_table(counts, classes)
    labels = F.count(F.when(F.col("support") > 0, 1))
    positive = F.col("class").cast("string") == "1"

    def pick(name: str) -> Column:
        macro, binary = F.avg(name), F.coalesce(F.max(F.when(positive, F.col(name))), F.lit(0.0))
        if average == "macro":
            return macro
        if average == "binary":
            return binary
        return F.when(labels > 2, macro).otherwise(binary)

    chosen = F.lit(average) if average else F.when(labels > 2, F.lit("macro")).otherwise(F.lit("binary"))
    return table.agg(
        F.coalesce(F.try_divide(F.sum("hits"), F.sum("support")), F.lit(0.0)).alias("accuracy"),
        pick("precision").alias("precision"),
        pick("recall").alias("recall"),
        pick("f1").alias("f1"),
        chosen.alias("average"),
        (labels > 2).alias("multiclass"),
    )


def lite_metrics(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Always macro, over the class ids 0 up to the highest id seen."""
    counts = confusion_counts(df, truth, prediction)
    table = class_table(counts)
    ids = F.max("class") + 1  # ids without any row count as zero in the means
    return table.agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        (F.sum("precision") / ids).alias("precision"),
        (F.sum("recall") / ids).alias("recall"),
        (F.sum("f1") / ids).alias("f1"),
        F.lit("macro").alias("average"),
        (ids > 2).alias("multiclass"),
    )


def per_class_metrics(df: DataFrame, truth: str, prediction: str, classes: list) -> DataFrame:
    return class_table(confusion_counts(df, truth, prediction), classes).select(
        "class", "precision", "recall", "f1", "support"
    )


def with_labels_and_tiers(
    per_class: DataFrame, labels: DataFrame, tiers: DataFrame, policy: TierPolicy = DEFAULT_TIERS
) -> DataFrame:
    """Add the original label and tier; order by tier, unknown tiers last.

    ``labels`` has ``(class, original_class)``, ``tiers`` has ``(class, tier)``
    keyed by the original label.
    """
    named = per_class.join(labels, "class", "left")
    t = tiers.select(F.col("class").alias("original_class"), "tier")
    return named.join(t, "original_class", "left").orderBy(tier_rank(F.col("tier"), policy), "class")


def tier_rank(tier: Column, policy: TierPolicy = DEFAULT_TIERS) -> Column:
    order = [name for name, _ in policy.descending()] + [policy.discard_label]
    expr = F.when(tier == order[0], F.lit(0))
    for i, name in enumerate(order[1:], 1):
        expr = expr.when(tier == name, F.lit(i))
    return expr.otherwise(F.lit(99))


def _score_table(df: DataFrame, truth: str, scores: str, classes: list) -> DataFrame:
    """Rows ``(class, score, pos, neg)``: counts per distinct score of each class."""
    label = F.get(F.array(*[F.lit(c) for c in classes]), F.col("class"))
    return (
        df.select(F.col(truth).alias("__truth"), F.posexplode(scores).alias("class", "score"))
        .filter(F.col("class") < len(classes))
        .select("class", "score", (F.col("__truth") == label).cast("long").alias("hit"))
        .groupBy("class", "score")
        .agg(F.sum("hit").alias("pos"), (F.count(F.lit(1)) - F.sum("hit")).alias("neg"))
    )


def ranking_metrics(df: DataFrame, truth: str, scores: str, classes: list, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Per class one-vs-rest ROC-AUC and average precision, ties averaged.

    Equal scores are merged before any ordering. The distinct scores are
    range-sorted into as many slices as their number asks for, ``slice_rows``
    in each, and written once; slice totals give each slice its starting sums,
    and running sums stay inside a slice. The result is exact wherever the cuts
    fall, and no class is sorted in one task.
    """
    table = _score_table(df, truth, scores, classes)
    most = df.count() * len(classes)  # distinct scores at most
    if most <= slice_rows:
        sliced = table.withColumn("slice", F.lit(0))
    else:
        slices = -(-most // slice_rows)
        sliced = materialize(table.repartitionByRange(slices, "class", "score").withColumn("slice", F.spark_partition_id()), "scores")
    totals = sliced.groupBy("class", "slice").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    up_to = Window.partitionBy("class").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("class")
    starts = totals.select(
        F.col("class").alias("__class"),
        F.col("slice").alias("__slice"),
        F.coalesce(F.sum("p").over(up_to), F.lit(0)).alias("p0"),
        F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("n0"),
        F.sum("p").over(whole).alias("pos_all"),
        F.sum("n").over(whole).alias("neg_all"),
    )
    joined = sliced.join(
        small_side(starts, len(classes) + -(-most // slice_rows)),  # a slice has one class, or is where two meet
        (F.col("class") == F.col("__class")) & (F.col("slice") == F.col("__slice")),
    )
    before = Window.partitionBy("class", "slice").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    p_below = F.col("p0") + F.coalesce(F.sum("pos").over(before), F.lit(0))
    n_below = F.col("n0") + F.coalesce(F.sum("neg").over(before), F.lit(0))
    running = joined.withColumn("p_below", p_below).withColumn("n_below", n_below)
    p_from = F.col("pos_all") - F.col("p_below")
    all_from = p_from + F.col("neg_all") - F.col("n_below")
    return running.groupBy("class", "pos_all", "neg_all").agg(
        F.try_divide(
            F.sum(F.col("pos") * (F.col("n_below") + F.col("neg") / F.lit(2.0))),
            F.first(F.col("pos_all").cast("double") * F.col("neg_all")),  # the product exceeds a long
        ).alias("roc_auc"),
        F.try_divide(F.sum(F.col("pos") * p_from / all_from), F.first("pos_all")).alias("pr_auc"),
    ).withColumnsRenamed({"pos_all": "positives", "neg_all": "negatives"})


def auc_summary(df: DataFrame, truth: str, scores: str, classes: list) -> DataFrame:
    """One row ``(roc_auc, pr_auc)``.

    More than two classes: macro mean over classes that have positives and
    negatives, null with fewer than two of them or when the score width differs
    from the class count. Otherwise the last class is the positive one.
    """
    table = ranking_metrics(df, truth, scores, classes).filter("positives > 0 AND negatives > 0")
    if len(classes) > 2:
        valid = F.count(F.lit(1))
        out = table.agg(
            F.when(valid >= 2, F.avg("roc_auc")).alias("roc_auc"), F.when(valid >= 2, F.avg("pr_auc")).alias("pr_auc")
        )
        widths = df.agg(F.bool_and(F.size(scores) == len(classes)).alias("ok")).scalar()
        return out.select(F.when(widths, F.col("roc_auc")).alias("roc_auc"), F.when(widths, F.col("pr_auc")).alias("pr_auc"))
    return table.filter(F.col("class") == len(classes) - 1).agg(
        F.max("roc_auc").alias("roc_auc"), F.max("pr_auc").alias("pr_auc")
    )


def evaluate(df: DataFrame, truth: str, prediction: str, scores: str | None, classes: list) -> dict[str, object]:
    """All figures of one scored set as plain values."""
    row = classification_metrics(df, truth, prediction).first().asDict()
    row["multiclass"] = len(classes) > 2
    row.update(
        auc_summary(df, truth, scores, classes).first().asDict() if scores else {"roc_auc": None, "pr_auc": None}
    )
    return row


def summarize_folds(folds: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean and population deviation per metric over fold rows."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return folds.select(F.inline(rows)).groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("folds")
    )


def fold_metrics(df: DataFrame, truth: str, prediction: str, fold: str) -> DataFrame:
    """Macro precision, recall and F1 per fold from one grouping."""
    counts = df.groupBy(fold, F.col(truth).alias("t"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("c"))
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("t") == F.col("p"), F.col("c")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("t").alias("class"), F.col("c").alias("support"), zero.alias("predicted"), hit.alias("hits")),
        F.struct(F.col("p").alias("class"), zero.alias("support"), F.col("c").alias("predicted"), zero.alias("hits")),
    )
    table = (
        counts.select(fold, F.inline(sides))
        .groupBy(fold, "class")
        .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
        .withColumn("precision", _ratio("hits", "predicted"))
        .withColumn("recall", _ratio("hits", "support"))
    )
    f1 = F.coalesce(
        F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)
    )
    return table.groupBy(fold).agg(
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"), F.avg(f1).alias("f1_macro")
    )
