"""Glossary of class codes from a source table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.contracts import GLOSSARY_COLUMNS
from calibra.functions.text import strip
from calibra.functions.types import require_columns
from calibra.session import materialize

# Situation labels and entry states.
SITUATIONS = {"A": "Aprovado", "R": "Reprovado"}
CONFIRMED = "confirmado"
PENDING = "pendente"

SCHEMA = (
    "code string, label string, description string, situacao_codigo string, situacao_label string, "
    "status string, tier string"
)


def build_glossary(
    source: DataFrame, order: str, tiers: DataFrame | None = None,
    columns: tuple[str, str, str] = GLOSSARY_COLUMNS,
) -> DataFrame:
    """One entry per stripped code, the first by ``order`` when a code repeats.

    A blank description, or one equal to the code, is pending. Situations other
    than the known ones are dropped. ``tiers`` has ``(class, tier)``.
    """
    require_columns(source, columns, "glossary columns")
    code, description, situation = columns
    # The first row per code is a minimum, so copies merge before the shuffle.
    first = (
        source.filter(F.col(code).isNotNull())
        .groupBy(strip(F.col(code).cast("string")).alias("__code"))
        .agg(F.min_by(F.struct(F.col(description).alias("d"), F.col(situation).alias("s")), order).alias("row"))
    )
    key = F.col("__code")
    text = strip(F.col("row.d").cast("string"))
    mark = F.upper(strip(F.col("row.s").cast("string")))
    out = first.select(
        key.alias("code"),
        F.when((text != "") & (text != key), text).alias("description"),
        F.when(mark.isin(*SITUATIONS), mark).alias("situacao_codigo"),
    )
    label = F.when(F.col("situacao_codigo") == "A", F.lit(SITUATIONS["A"])).when(
        F.col("situacao_codigo") == "R", F.lit(SITUATIONS["R"])
    )
    out = out.select(
        "code",
        F.col("description").alias("label"),
        "description",
        "situacao_codigo",
        label.alias("situacao_label"),
        F.when(F.col("description").isNull(), F.lit(PENDING)).otherwise(F.lit(CONFIRMED)).alias("status"),
    )
    if tiers is None:
        return out.withColumn("tier", F.lit(None).cast("string"))
    side = tiers.select(F.col("class").alias("__class"), "tier")
    return out.join(side, F.col("code") == F.col("__class"), "left").drop("__class")


def load_tiers(spark, path: str) -> DataFrame:
    """Rows ``(class, tier)`` of a stored class-weight registry, none when it is missing or broken.

    For :func:`build_glossary`; entries without a class or a tier are left out.
    """
    shape = "classes array<struct<class:string,tier:string>>"
    empty = spark.createDataFrame([], "class string, tier string")
    try:
        text = spark.read.option("wholetext", True).text(path)
        rows = text.select(F.inline(F.from_json("value", shape)["classes"])).filter("class IS NOT NULL AND tier IS NOT NULL")
        return materialize(rows, "tiers")
    except Exception:  # a missing registry never stops a glossary
        return empty


def empty_glossary(spark) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def load_glossary(spark, path: str) -> tuple[DataFrame, str]:
    """The stored glossary and its status; ``empty`` when it cannot be read.

    It is read whole here, so a file that is broken inside is noticed.
    """
    try:
        return materialize(spark.read.schema(SCHEMA).parquet(path), "glossary"), CONFIRMED
    except Exception:  # a missing or broken glossary never stops scoring
        return empty_glossary(spark), "empty"


def glossary_counts(glossary: DataFrame) -> DataFrame:
    return glossary.agg(
        F.count(F.lit(1)).alias("classes"),
        F.count(F.when(F.col("status") == CONFIRMED, 1)).alias("confirmed"),
        F.count(F.when(F.col("status") == PENDING, 1)).alias("pending"),
        F.count(F.when(F.col("situacao_codigo") == "A", 1)).alias("approved"),
        F.count(F.when(F.col("situacao_codigo") == "R", 1)).alias("rejected"),
    )
