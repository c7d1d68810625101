"""Dense positions over a whole table without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibra.session import materialize, small_side

_SLOT_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def sorted_index(
    distinct: DataFrame, columns: list[str], name: str = "code", within: str | None = None
) -> tuple[DataFrame, int]:
    """The distinct rows with their 0-based position in the order of ``columns``, and their number.

    The sort is range-partitioned. The sorted rows are written once, so that
    positions and partition offsets come from the same run. ``within`` (the
    first sort column) restarts the count at each of its values.
    """
    placed = materialize(
        distinct.select(*columns).orderBy(*columns).withColumn("__id", F.monotonically_increasing_id()), "index"
    )
    part = F.shiftright("__id", _SLOT_BITS)
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("c"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per sort partition: bounded by the shuffle partition setting.
    offsets = counts.select(F.col("part").alias("__part"), F.coalesce(F.sum("c").over(order), F.lit(0)).alias("__from"))
    position = F.col("__from") + F.col("__id").bitwiseAND(F.lit((1 << _SLOT_BITS) - 1))
    indexed = placed.join(small_side(offsets, 100_000), part == F.col("__part")).select(
        *columns, position.alias(name)
    )
    total = placed.count()
    if within is None:
        return indexed, total
    starts = indexed.groupBy(F.col(within).alias("__within")).agg(F.min(name).alias("__start"))
    counted = indexed.join(starts, F.col(within) == F.col("__within")).select(
        *columns, (F.col(name) - F.col("__start")).alias(name)
    )
    return counted, total


def sums_before(rows: DataFrame, order: list[str], value: str, name: str, slices: int) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows before them in ``order``, which tells rows apart.

    Two levels: the rows are range-sorted into ``slices`` and written once;
    running sums stay inside a slice, and the totals of the slices before it,
    one row a slice, are added.
    """
    placed = rows.repartitionByRange(slices, *order).withColumn("__slice", F.spark_partition_id())
    placed = materialize(placed, "running")
    totals = placed.groupBy(F.col("__slice").alias("__of")).agg(F.sum(value).alias("__total"))
    earlier = Window.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__of", F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(small_side(starts, slices), F.col("__slice") == F.col("__of"))
    before = F.col("__start") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return joined.withColumn(name, before).drop("__slice", "__of", "__start")
