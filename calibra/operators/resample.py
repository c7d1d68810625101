"""Rebalancing of training rows: random copies, SMOTE, ADASYN.

Draws come from hashes of the row key, so a run is repeatable on any cluster.
Each minority row gives an even share of the synthetic rows; the remainder goes
to the first rows in hash order, found by a cut rather than a sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.functions.hashing import hash_int, order_hash, unit_interval
from calibra.operators.neighbors import nearest
from calibra.operators.ranking import HASH, rank_cuts, with_hash
from calibra.session import materialize, small_side

STRATEGIES = ("smote", "adasyn", "random_oversample")
NEIGHBORS = 5
COPY_RUN = 1024  # copies of one row that a task makes in one go


def normalize_strategy(strategy: str | None) -> str | None:
    """``none``, ``nenhum`` and empty mean no resampling; others must be known."""
    name = (strategy or "").strip().lower()
    if name in ("", "none", "nenhum"):
        return None
    if name not in STRATEGIES:
        raise ValueError(f"unknown resampling strategy {strategy!r}; known: {', '.join(STRATEGIES)}")
    return name


def class_gaps(df: DataFrame, target: str) -> DataFrame:
    """Table ``(target, n, extra)``: rows each class lacks to the largest, written once."""
    counts = materialize(df.groupBy(target).agg(F.count(F.lit(1)).alias("n")), "gaps")
    return counts.withColumn("extra", counts.agg(F.max("n").alias("m")).scalar() - F.col("n"))


def _with_copies(df: DataFrame, target: str, key: str, gaps: DataFrame, seed: int) -> DataFrame:
    """Rows of classes that lack rows, with the number of copies each row gives."""
    classes, largest = gaps.agg(F.count(F.lit(1)), F.max("n")).first()
    need = gaps.filter("extra > 0").select(
        F.col(target).alias("__class"),
        F.floor(F.col("extra") / F.col("n")).alias("__each"),
        (F.col("extra") % F.col("n")).alias("rank"),
    )
    hashed = with_hash(df, seed, [key]).join(small_side(need, classes), F.col(target).eqNullSafe(F.col("__class")))
    wanted = need.filter("rank > 0").select(F.col("__class").alias(target), "rank")
    cuts = rank_cuts(hashed, target, wanted, classes, largest=largest or 0).select(F.col(target).alias("__by"), "cut")
    joined = hashed.join(small_side(cuts, classes), F.col(target).eqNullSafe(F.col("__by")), "left")
    more = F.coalesce((F.col(HASH) <= F.col("cut")).cast("long"), F.lit(0))
    return joined.withColumn("copies", F.col("__each") + more).drop(HASH, "__class", "__each", "rank", "__by", "cut")


def _copied(df: DataFrame) -> DataFrame:
    """Rows with ``copy`` numbers 1 to ``copies``; a row with many copies is dealt to several tasks."""
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPY_RUN))
    dealt = df.withColumn("__part", F.explode(parts))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(tasks)
    first = F.col("__part") * COPY_RUN + 1
    last = F.least(F.col("copies"), first + (COPY_RUN - 1))
    return dealt.withColumn("copy", F.explode(F.sequence(first, last))).drop("__part")


def random_oversample(df: DataFrame, target: str, key: str, seed: int = 42) -> DataFrame:
    """Repeat rows of smaller classes up to the size of the largest."""
    extra = _with_copies(df, target, key, class_gaps(df, target), seed)
    copies = _copied(extra.filter("copies > 0"))
    return df.withColumn("copy", F.lit(0).cast("long")).unionByName(copies.drop("copies"))


def _interpolate(
    rows: DataFrame, minority: DataFrame, target: str, key: str, vector: str, k: int, seed: int, options: dict
) -> DataFrame:
    """Synthetic rows between each source row and one of its class neighbours."""
    ends = minority.select(key, target, F.col(vector).cast("array<double>").alias(vector))
    near = nearest(rows, ends, key, vector, k, group=target, payload=vector, **options).select(
        F.col(key).alias("__key"), "neighbors"
    )
    joined = rows.select(key, target, F.col(vector).cast("array<double>").alias("__from"), "copies").join(
        near, F.col(key) == F.col("__key")
    )
    drawn = (
        _copied(joined)
        .withColumn("__draw", order_hash(f"{seed}:draw", key, "copy"))
        .withColumn("__pick", (hash_int(F.col("__draw"), 9, 8) % F.size("neighbors")).cast("int"))
        .withColumn("neighbor", F.get("neighbors", F.col("__pick")).getField("id"))
        .withColumn("__to", F.get("neighbors", F.col("__pick")).getField("payload"))
        .withColumn("step", unit_interval(F.col("__draw")))
        .drop("neighbors", "__key")
    )
    between = F.zip_with("__from", "__to", lambda a, b: a + F.col("step") * (b - a))
    return drawn.select(F.col(key).alias("source"), "neighbor", "copy", "step", target, between.alias(vector))


def _minority(df: DataFrame, target: str, gaps: DataFrame) -> DataFrame:
    lacking = gaps.filter("extra > 0").select(F.col(target).alias("__class"))
    return df.join(small_side(lacking, gaps.count()), F.col(target).eqNullSafe(F.col("__class")), "left_semi")


def _check_sizes(gaps: DataFrame, k: int, strict: bool) -> None:
    smallest = gaps.filter("extra > 0").agg(F.min("n")).first()[0]
    limit = k + 1 if strict else 2
    if smallest is not None and smallest < limit:
        raise ValueError(f"a class with {smallest} row(s) has too few neighbours (needs {limit})")


def smote_rows(
    df: DataFrame, target: str, key: str, vector: str, k: int = NEIGHBORS, seed: int = 42, strict: bool = False,
    **options,
) -> DataFrame:
    """Synthetic rows that lift every class to the size of the largest.

    A class with ``n <= k`` rows uses its ``n - 1`` neighbours; ``strict``
    rejects it instead. The largest class is never searched.
    """
    gaps = class_gaps(df, target)
    _check_sizes(gaps, k, strict)
    rows = _with_copies(df, target, key, gaps, seed).filter("copies > 0")
    return _interpolate(rows, _minority(df, target, gaps), target, key, vector, k, seed, options)


def adasyn_ratio(
    df: DataFrame, target: str, key: str, vector: str, k: int = NEIGHBORS, gaps: DataFrame | None = None, **options
) -> DataFrame:
    """Per minority row: neighbours of other classes among the ``k`` nearest of all."""
    gaps = gaps if gaps is not None else class_gaps(df, target)
    rows = _minority(df, target, gaps)
    near = nearest(rows, df, key, vector, k, payload=target, **options).select(F.col(key).alias("__key"), "neighbors")
    other = F.size(F.filter("neighbors", lambda n: n["payload"] != F.col(target)))
    return rows.join(near, F.col(key) == F.col("__key")).select(
        *df.columns, other.alias("other"), (other / F.lit(float(k))).alias("ratio")
    )


def adasyn_rows(
    df: DataFrame, target: str, key: str, vector: str, k: int = NEIGHBORS, seed: int = 42, **options
) -> DataFrame:
    """Synthetic rows, more of them where other classes are near."""
    gaps = class_gaps(df, target)
    _check_sizes(gaps, k, False)
    # The neighbour search runs once; the checks and the plan read its result.
    ratios = materialize(adasyn_ratio(df, target, key, vector, k, gaps, **options), "ratios")
    sums = ratios.groupBy(F.col(target).alias("__class")).agg(F.sum("other").alias("__sum"))
    plan = gaps.select(F.col(target).alias("__c"), "extra").join(sums, F.col("__c") == F.col("__class"))
    share: Column = F.col("other") / F.nullif(F.col("__sum"), F.lit(0)) * F.col("extra")
    rows = (
        ratios.join(small_side(plan, gaps.count()), F.col(target) == F.col("__class"))
        .withColumn("copies", F.coalesce(F.bround(share, 0), F.lit(0)).cast("long"))
        .select(*df.columns, "copies")
    )
    made = rows.groupBy(target).agg(F.sum("copies").alias("made"))
    idle = [r[target] for r in made.filter("made = 0").limit(10).collect()]
    if idle:
        raise ValueError(f"no synthetic row would be made for class(es) {idle}; use smote")
    source = rows.filter("copies > 0")
    return _interpolate(source, _minority(df, target, gaps), target, key, vector, k, seed, options)


def resample(
    df: DataFrame, strategy: str | None, target: str, key: str, vector: str, seed: int = 42, k: int = NEIGHBORS,
    **options,
) -> DataFrame:
    """Training rows ``(target, vector)`` after the strategy; for training data only."""
    name = normalize_strategy(strategy)
    plain = df.select(target, F.col(vector).cast("array<double>").alias(vector))
    if name is None:
        return plain
    if name == "random_oversample":
        return random_oversample(df, target, key, seed).select(*plain.columns)
    make = smote_rows if name == "smote" else adasyn_rows
    return plain.unionByName(make(df, target, key, vector, k, seed, **options).select(*plain.columns))
