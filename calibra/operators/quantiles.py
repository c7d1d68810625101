"""Exact interpolated quantiles by repeated counting, without gathering a group in one task.

A sketch per group and column turns each wanted rank into a bracket of values
around it. A counting pass collapses everything outside the brackets to one row
per gap with count, least and largest value, also on the map side; the values
of a bracket come one by one only when at most about ``FEW`` are expected, and
otherwise collapse as well. Counts tell for certain which row holds a rank. A
rank that lies inside a collapsed row, because its bracket was large or the
sketch was off, is searched on: the row's range is the next range, a grid of
sketched cut points narrows it, and so on until the value is known. The last
sort of a group and column sees a bounded number of rows, however many there
are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibra.functions.hashing import any_of
from calibra.session import checked_side, materialize, small_side

ACCURACY = 10_000
FEW = 8192  # values of a bracket that are told apart
GRID = 512  # cut points of a later round


def _sketches(wide: DataFrame, width: int, probs: list[float], by: list[str], accuracy: int, few: int) -> DataFrame:
    """One row per group: for each column the bracket points, and whether its brackets hold few values."""
    eps = 2.0 / accuracy
    points = [p for q in probs for p in (max(0.0, q - eps), min(1.0, q + eps))]
    aggs: list[Column] = []
    for i in range(width):
        value = F.get("values", F.lit(i))
        aggs.append(F.percentile_approx(value, points, accuracy).alias(f"__p{i}"))
        aggs.append((F.count(value) * (4.0 / accuracy) <= few).alias(f"__f{i}"))
    ends = F.array(*[F.struct(F.col(f"__p{i}").alias("points"), F.col(f"__f{i}").alias("fine")) for i in range(width)])
    return wide.groupBy(*by).agg(*aggs).select(*by, ends.alias("ends"))


def _counted(rows: DataFrame, keep: list[str], probs: list[float]) -> DataFrame:
    """Rows ``(keep..., col, c, vmin, vmax)`` from values and bracket points.

    A bracket's values are told apart where they are few; a gap between the
    brackets, or a bracket with many values, is one row. All this happens after
    the explode, as one small expression for any number of columns.
    """
    value = F.col("value")
    long = rows.select(*keep, "ends", F.posexplode("values").alias("col", "value")).filter(value.isNotNull())
    own = F.get("ends", F.col("col"))
    ends = [(own["points"][2 * k], own["points"][2 * k + 1]) for k in range(len(probs))]
    inside = any_of([(value >= lo) & (value <= hi) for lo, hi in ends])
    slot = sum(((value > hi).cast("int") + (value >= lo).cast("int") for lo, hi in ends), F.lit(0))
    placed = long.select(*keep, "col", slot.alias("slot"), F.when(inside & own["fine"], value).alias("at"), "value")
    return placed.groupBy(*keep, "col", "slot", "at").agg(
        F.count(F.lit(1)).alias("c"), F.min("value").alias("vmin"), F.max("value").alias("vmax")
    )


def _ranked(counted: DataFrame, keys: list[str], start: Column | None = None, last: Column | None = None) -> DataFrame:
    """The rows with the ranks before and up to them, and the least value after them."""
    order = Window.partitionBy(*keys).orderBy("vmin")
    upto, after = F.sum("c").over(order), F.lead("vmin").over(order)
    if start is not None:
        upto, after = start + upto, F.coalesce(after, last)
    return counted.withColumns({"upto": upto, "before": upto - F.col("c"), "next": after})


def _values(hit: DataFrame) -> DataFrame:
    """``v1`` at the rank and ``v2`` at the rank after it, null where the row does not tell."""
    rank, single = F.col("rank"), F.col("vmin") == F.col("vmax")
    first = F.when(single | (rank == F.col("before") + 1), F.col("vmin")).when(rank == F.col("upto"), F.col("vmax"))
    second = (
        F.when(~F.col("needs_next"), first)
        .when(rank == F.col("upto"), F.col("next"))
        .when(single, F.col("vmin"))
        .when(rank + 1 == F.col("upto"), F.col("vmax"))
    )
    return hit.withColumns({"v1": first, "v2": second})


def _wanted(n: Column, probs: list[float]) -> Column:
    """For every probability its rank, and whether the value after it counts too."""
    out = []
    for k, q in enumerate(probs):
        at = (n - 1) * F.lit(float(q))
        out.append(F.struct(F.lit(k).alias("k"), (F.floor(at) + 1).cast("long").alias("rank"), (at > F.floor(at)).alias("needs_next")))
    return F.array(*out)


def _narrowed(wide: DataFrame, by: list[str], open_: DataFrame, accuracy: int, few: int) -> DataFrame:
    """The open ranks after one more round: a grid over their ranges, then counts."""
    keys = [*by, "col", "k"]
    kept = [*keys, "n", "rank", "needs_next"]

    def values(states: DataFrame, fields: list[str]) -> DataFrame:
        """keys, fields and value of the rows inside the range of a state."""
        side = states.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.struct("col", "k", "vmin", "vmax", *fields).alias("s"))
        side = checked_side(side.groupBy(*[f"__by_{c}" for c in by]).agg(F.collect_list("s").alias("states")), "ranges")
        match = [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by]
        rows = wide.join(side, match) if by else wide.withColumn("states", side.scalar())
        rows = rows.select(*by, "states", F.posexplode("values").alias("__col", "value"))
        own = F.filter("states", lambda s: (s["col"] == F.col("__col")) & (F.col("value") >= s["vmin"]) & (F.col("value") <= s["vmax"]))
        return rows.select(*by, "value", F.inline(own)).drop("vmin", "vmax")

    cuts = [i / GRID for i in range(GRID + 1)]
    grid = values(open_, []).groupBy(*keys).agg(F.percentile_approx("value", cuts, accuracy).alias("grid"))
    at = F.floor((F.col("rank") - F.col("before") - 0.5) / F.col("c") * GRID).cast("int")
    match = [F.col(c).eqNullSafe(F.col(f"__g_{c}")) for c in keys]
    named = grid.select(*[F.col(c).alias(f"__g_{c}") for c in keys], "grid")
    states = open_.join(named, match).withColumns(
        {
            "lo": F.get("grid", F.greatest(at - 1, F.lit(0))),
            "hi": F.get("grid", F.least(at + 2, F.lit(GRID))),
            "fine": F.col("c") * (4.0 / GRID + 4.0 / accuracy) <= few,
        }
    )
    states = materialize(states.drop("grid", *[f"__g_{c}" for c in keys]), "quantile-ranges")
    value = F.col("value")
    placed = values(states, ["lo", "hi", "fine"]).withColumns(
        {
            "slot": (value >= F.col("lo")).cast("int") + (value > F.col("hi")).cast("int"),
            "at": F.when((value >= F.col("lo")) & (value <= F.col("hi")) & F.col("fine"), value),
        }
    )
    counted = placed.groupBy(*keys, "slot", "at").agg(F.count(F.lit(1)).alias("c"), F.min("value").alias("vmin"), F.max("value").alias("vmax"))
    old = states.select(*[F.col(c).alias(f"__s_{c}") for c in keys], "n", "rank", "needs_next", F.col("before").alias("start"), F.col("next").alias("last"))
    both = counted.join(old, [F.col(c).eqNullSafe(F.col(f"__s_{c}")) for c in keys])
    ranked = _ranked(both, keys, F.col("start"), F.col("last"))
    hit = ranked.filter((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("upto")))
    return _values(hit).select(*kept, "before", "upto", "c", "vmin", "vmax", "next", "v1", "v2")


def _first_round(wide: DataFrame, sketches: DataFrame, by: list[str], probs: list[float], group_bound: float | None) -> DataFrame:
    """One row per group, column and probability: the counted row that holds its rank."""
    if by:
        side = sketches.withColumnsRenamed({c: f"__by_{c}" for c in by})
        match = [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by]
        rows = wide.join(small_side(side, group_bound) if group_bound else checked_side(side, "brackets"), match)
    else:
        rows = wide.withColumn("ends", sketches.scalar())
    keys = [*by, "col"]
    ranked = _ranked(_counted(rows, by, probs), keys).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    held = F.filter(_wanted(F.col("n"), probs), lambda w: (w["rank"] > F.col("before")) & (w["rank"] <= F.col("upto")))
    hit = ranked.select(*keys, "n", "before", "upto", "c", "vmin", "vmax", "next", F.inline(held))
    return _values(hit).select(*keys, "k", "n", "rank", "needs_next", "before", "upto", "c", "vmin", "vmax", "next", "v1", "v2")


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probs: list[float],
    by: list[str] | None = None,
    group_bound: float | None = None,
    accuracy: int = ACCURACY,
    few: int = FEW,
) -> DataFrame:
    """Rows ``(by..., column, n, q0, q1, ...)`` with one ``q`` per probability.

    The brackets are broadcast, so the data is never shuffled whole; their
    number is the number of groups, which is counted first unless
    ``group_bound`` gives a proven limit.
    """
    spark, groups = df.sparkSession, by or []
    by = [f"__group{i}" for i in range(len(groups))]  # no clash with the names used here
    named = [F.col(c).alias(b) for c, b in zip(groups, by, strict=True)]
    wide = df.select(*named, F.array(*[F.col(c).cast("double") for c in columns]).alias("values"))
    found = _first_round(wide, _sketches(wide, len(columns), probs, by, accuracy, few), by, probs, group_bound)
    if by:
        found = materialize(found, "quantiles")
    else:  # a few numbers for each column
        found = spark.createDataFrame(found.collect(), found.schema)
    unsure = F.col("v1").isNull() | F.col("v2").isNull()
    while not found.filter(unsure).isEmpty():
        rest = materialize(_narrowed(wide, by, found.filter(unsure), accuracy, few), "quantiles")
        found = found.filter(~unsure).unionByName(rest)
    outs = []
    for k, q in enumerate(probs):
        at = (F.col("n") - 1) * F.lit(float(q))
        v1, v2 = (F.max(F.when(F.col("k") == k, F.col(v))) for v in ("v1", "v2"))
        outs.append((v1 + (v2 - v1) * (at - F.floor(at))).alias(f"q{k}"))
    name = F.get(F.array(*[F.lit(c) for c in columns]), F.col("col"))
    picked = found.groupBy(*by, "col", "n").agg(*outs)
    back = [F.col(b).alias(c) for c, b in zip(groups, by, strict=True)]
    return picked.select(*back, name.alias("column"), "n", *[f"q{k}" for k in range(len(probs))])


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact median per column; the result has one value per column."""
    if not columns:
        return {}
    rows = exact_quantiles(df, columns, [0.5]).collect()
    return {r["column"]: r["q0"] for r in rows}
