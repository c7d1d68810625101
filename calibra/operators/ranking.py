"""Ranks within a class by hash order, without sorting a class in one task.

Rows of a class are ordered by the md5 of seed and key. Radix selection finds
the row of a wanted rank: the leading hex digits cut each class into even
buckets, counts per bucket locate the one that holds the rank, and within it the
next digits are counted, as often as the size of the largest class asks for.
The rows of the last buckets, at most about ``BUCKET_ROWS`` each, are ranked.
The result is one cut hash per wanted rank: the data is then split by a plain
comparison, with no shuffle of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibra.functions.hashing import order_hash
from calibra.session import small_side

HASH, CLASS = "__hash", "__class_of_row"
BUCKET_DIGITS = 3  # of one round
BUCKET_ROWS = 1 << 18  # rows that are ranked together


def with_hash(df: DataFrame, seed: int | str, keys: list[str]) -> DataFrame:
    return df.withColumn(HASH, order_hash(seed, *keys))


def radix_rounds(largest: int, digits: int = BUCKET_DIGITS) -> int:
    """Rounds until a bucket of the largest class is expected to hold BUCKET_ROWS rows."""
    rounds, width = 1, 16**digits
    while largest > BUCKET_ROWS * width**rounds and digits * rounds < 30:
        rounds += 1
    return rounds


def rank_cuts(
    hashed: DataFrame,
    by: str,
    wanted: DataFrame,
    bound: float | None = None,
    digits: int = BUCKET_DIGITS,
    largest: int = 0,
) -> DataFrame:
    """Cut hashes for the ranks in ``wanted (by, rank)``: rows ``(by, rank, cut)``.

    Row number ``rank`` (1-based, hash order) of its class has hash ``cut``.
    ``hashed`` carries the order hash in ``__hash``; keys should identify rows.
    Rows with one key share a hash and stay on one side of a cut; they are
    counted together, so a key with very many rows is no hot spot. ``largest``
    is the number of rows of the largest class.
    """
    hashed = hashed.select(F.col(by).alias(CLASS), HASH)  # no clash with the names used here
    open_ = wanted.select(F.col(by).alias("__by"), F.col("rank").alias("__rank"), F.col("rank").alias("need"), F.lit("").alias("__prefix"))
    for turn in range(radix_rounds(largest, digits)):
        rows = _inside(hashed, open_, bound, digits * turn)
        bucket = F.substring(HASH, 1, digits * (turn + 1)).alias("bucket")
        counts = rows.select(CLASS, "prefix", bucket).groupBy(CLASS, "prefix", "bucket").agg(F.count(F.lit(1)).alias("c"))
        order = Window.partitionBy(CLASS, "prefix").orderBy("bucket")
        spans = counts.withColumn("upto", F.sum("c").over(order)).withColumn("before", F.col("upto") - F.col("c"))
        held = (F.col("need") > F.col("before")) & (F.col("need") <= F.col("upto"))
        open_ = spans.join(
            small_side(open_, bound), (F.col(CLASS) == F.col("__by")) & (F.col("prefix") == F.col("__prefix")) & held
        ).select("__by", "__rank", (F.col("need") - F.col("before")).alias("need"), F.col("bucket").alias("__prefix"))
    needs = open_.groupBy("__by", "__prefix").agg(F.collect_list(F.struct("need", "__rank")).alias("needs"))
    rows = hashed.select(CLASS, HASH, F.substring(HASH, 1, digits * radix_rounds(largest, digits)).alias("bucket"))
    inner = rows.join(small_side(needs, bound), (F.col(CLASS) == F.col("__by")) & (F.col("bucket") == F.col("__prefix")))
    merged = inner.groupBy(CLASS, "bucket", HASH).agg(F.count(F.lit(1)).alias("c"), F.first("needs").alias("needs"))
    ranked = merged.withColumn("rn", F.sum("c").over(Window.partitionBy(CLASS, "bucket").orderBy(HASH)))
    hit = F.filter("needs", lambda x: (x["need"] <= F.col("rn")) & (x["need"] > F.col("rn") - F.col("c")))
    return ranked.filter(F.size(hit) > 0).select(
        CLASS, F.inline(F.transform(hit, lambda x: F.struct(x["__rank"].alias("rank")))), F.col(HASH).alias("cut")
    ).withColumnRenamed(CLASS, by)


def _inside(hashed: DataFrame, open_: DataFrame, bound: float | None, done: int) -> DataFrame:
    """Class, hash and prefix of the rows in a bucket that is still open; all rows before the first round."""
    if not done:
        return hashed.select(CLASS, HASH, F.lit("").alias("prefix"))
    buckets = small_side(open_.select("__by", "__prefix").distinct(), bound)
    rows = hashed.select(CLASS, HASH, F.substring(HASH, 1, done).alias("prefix"))
    return rows.join(buckets, (F.col(CLASS) == F.col("__by")) & (F.col("prefix") == F.col("__prefix"))).select(CLASS, HASH, "prefix")


def cut_lists(cuts: DataFrame, by: str) -> DataFrame:
    """One row per class with its ordered cut hashes (one per wanted rank)."""
    return cuts.groupBy(F.col(by).alias("__by")).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "cut"))), lambda x: x["cut"]
        ).alias("cuts")
    )


def cuts_passed(cuts: Column) -> Column:
    """How many of the class's cuts lie before the row."""
    return F.coalesce(F.size(F.filter(cuts, lambda c: F.col(HASH) > c)), F.lit(0))
