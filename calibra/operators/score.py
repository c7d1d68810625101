"""Scoring results: probabilities, tiers, texts, glossary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.config import DEFAULT_TIERS, TierPolicy
from calibra.functions.text import fixed
from calibra.functions.types import require_columns
from calibra.session import materialize, small_side

# Confidence limit and number of classes shown below it.
HIGH_CONFIDENCE = 0.90
SHOWN = 3

# Result texts.
MANUAL = "Revisão manual"
TIER_TEXTS = {
    "A": "Camada A: classe dominante no histórico de treino (≥15% das amostras) — sinal de maior confiabilidade estatística.",
    "B": "Camada B: classe com representação intermediária (1–15%) — sinal sólido, porém menos frequente que as classes da camada A.",
    "C": "Camada C: classe rara (0,1–1%) — zona cinza; recomenda-se atenção adicional na validação do laudo.",
}
TIER_FALLBACK = "Camada %s: sem descrição padrão cadastrada."
SHORT_TEXT = "Classe %s (camada %s)"
LONG_TEXT = "Classe prevista: %s (camada %s)."
WEIGHT_TEXT = "Peso balanceado da classe no treino: %s."
NO_WEIGHT_TEXT = "Peso da classe não disponível no registry."
OUTSIDE_TEXT = "Classe prevista %s está fora do escopo do registry (camada %s) ou não consta em class_weight_registry.json."
OUTSIDE_ADVICE = "Recomenda-se revisão manual do laudo."
PROBA_TEXT = "Probabilidade da classe prevista (predict_proba): %s."

PAIRS = "array<struct<class:string,proba:double>>"


def feature_projection(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Only the model's columns; all missing ones are named in one error."""
    require_columns(df, columns, "feature columns")
    return df.select(*columns)


def confidence_limit(value: str | float | None) -> float:
    """Configured limit; blank or unreadable settings give the default."""
    try:
        return HIGH_CONFIDENCE if value is None or str(value).strip() == "" else float(value)
    except ValueError:
        return HIGH_CONFIDENCE


def proba_pairs(classes: Column, probabilities: Column) -> Column:
    """Classes with their probability in class order, cut to the shorter list."""
    n = F.least(F.size(classes), F.size(probabilities))
    return F.coalesce(
        F.transform(
            F.arrays_zip(F.slice(classes, 1, n).alias("c"), F.slice(probabilities, 1, n).alias("p")),
            lambda x: F.struct(x["c"].cast("string").alias("class"), x["p"].cast("double").alias("proba")),
        ),
        F.array().cast(PAIRS),
    )


def sort_pairs(pairs: Column) -> Column:
    """Highest probability first; equal ones keep their order."""
    numbered = F.transform(
        pairs, lambda x, i: F.struct((-x["proba"]).alias("minus"), i.alias("at"), x["class"].alias("class"))
    )
    return F.transform(
        F.array_sort(numbered), lambda x: F.struct(x["class"].alias("class"), (-x["minus"]).alias("proba"))
    )


def proba_of(pairs: Column, code: Column) -> Column:
    return F.get(F.filter(pairs, lambda x: x["class"] == code), F.lit(0)).getField("proba")


def trim_pairs(pairs: Column, predicted: Column, limit: float = HIGH_CONFIDENCE, shown: int = SHOWN) -> Column:
    """A confident prediction stands alone; otherwise it leads the top classes."""
    own = F.filter(pairs, lambda x: x["class"].eqNullSafe(predicted))
    others = sort_pairs(F.filter(pairs, lambda x: ~x["class"].eqNullSafe(predicted)))
    mixed = F.concat(own, F.slice(others, 1, F.lit(shown) - F.size(own)))
    return F.when(F.get(own, F.lit(0)).getField("proba") >= limit, own).otherwise(mixed)


def decode_label(df: DataFrame, classes: list[str], prediction: str = "prediction", name: str = "classe_prevista") -> DataFrame:
    """Class label of the predicted index; an index outside the list is an error."""
    labels = F.array(*[F.lit(c) for c in classes])
    index = F.col(prediction).cast("int")
    known = (index >= 0) & (index < len(classes))
    # Negative positions would count from the end, so they are checked as well.
    broken = F.raise_error(F.format_string("class index %d outside the class list", index)).cast("string")
    return df.withColumn(name, F.when(index.isNull(), None).when(known, F.get(labels, index)).otherwise(broken))


def tier_lookup(
    df: DataFrame, registry: DataFrame, code: str = "classe_prevista", policy: TierPolicy = DEFAULT_TIERS,
    bound: float | None = None,
) -> DataFrame:
    """Add ``camada`` and ``peso``; a class outside the registry gets the discard tier."""
    side = registry.select(F.col("class").alias("__class"), F.col("tier").alias("__tier"), F.col("weight").alias("peso"))
    joined = df.join(small_side(side, bound), F.col(code).cast("string") == F.col("__class"), "left")
    return joined.withColumn("camada", F.coalesce("__tier", F.lit(policy.discard_label))).drop("__class", "__tier")


def result_text(code: Column, tier: Column, discard: str = DEFAULT_TIERS.discard_label) -> Column:
    return F.when(tier == discard, F.lit(MANUAL)).otherwise(F.format_string(SHORT_TEXT, code, tier))


def result_detail(
    code: Column, tier: Column, weight: Column, proba: Column, discard: str = DEFAULT_TIERS.discard_label
) -> Column:
    """Explanation with tier, weight and, when known, the probability."""
    blurb = F.format_string(TIER_FALLBACK, tier)
    for name, text in TIER_TEXTS.items():
        blurb = F.when(tier == name, F.lit(text)).otherwise(blurb)
    weight_text = F.when(weight.isNotNull(), F.format_string(WEIGHT_TEXT, fixed(weight, 6))).otherwise(F.lit(NO_WEIGHT_TEXT))
    outside = F.concat_ws(" ", F.format_string(OUTSIDE_TEXT, code, F.lit(discard)), F.lit(OUTSIDE_ADVICE))
    inside = F.concat_ws(" ", F.format_string(LONG_TEXT, code, tier), blurb, weight_text)
    tail = F.when(proba.isNotNull(), F.format_string(PROBA_TEXT, fixed(proba, 4)))
    return F.concat_ws(" ", F.when(tier == discard, outside).otherwise(inside), tail)


def add_results(
    df: DataFrame, registry: DataFrame, limit: float = HIGH_CONFIDENCE, policy: TierPolicy = DEFAULT_TIERS,
    bound: float | None = None,
) -> DataFrame:
    """From ``classe_prevista`` and full ``predict_proba`` to the result fields."""
    out = tier_lookup(df, registry, "classe_prevista", policy, bound)
    out = out.withColumn("predict_proba", trim_pairs(F.col("predict_proba"), F.col("classe_prevista"), limit))
    out = out.withColumn("probabilidade", proba_of(F.col("predict_proba"), F.col("classe_prevista")))
    code, tier = F.col("classe_prevista"), F.col("camada")
    return out.withColumn("resultado", result_text(code, tier, policy.discard_label)).withColumn(
        "resultado_detalhado",
        result_detail(code, tier, F.col("peso"), F.col("probabilidade"), policy.discard_label),
    )


def with_glossary(
    df: DataFrame, glossary: DataFrame, codes: dict[str, Column], bound: float | None = None
) -> DataFrame:
    """Left-join glossary entries (as structs) for each named code column.

    At most four codes per row are looked up, so equi joins stand in for
    explode and regroup; the same table serves all of them. Its rows are
    counted unless ``bound`` gives their number.
    """
    if bound is None:
        glossary = materialize(glossary, "glossary")
        bound = glossary.count()
    entry = glossary.select(
        F.col("code").alias("__code"),
        F.struct("code", "label", "description", "situacao_label", "status").alias("__entry"),
    )
    out = df
    for name, code in codes.items():
        side = small_side(entry.withColumnsRenamed({"__code": f"__code_{name}", "__entry": name}), bound)
        out = out.withColumn(f"__key_{name}", code).join(
            side, F.col(f"__key_{name}") == F.col(f"__code_{name}"), "left"
        ).drop(f"__key_{name}", f"__code_{name}")
    return out


def pair_code(position: int, pairs: str = "predict_proba") -> Column:
    return F.get(pairs, F.lit(position)).getField("class")


def enrich(df: DataFrame, glossary: DataFrame, bound: float | None = None) -> DataFrame:
    """Add situation and descriptions of the predicted class and of all shown classes.

    ``dsc_predict_proba`` keeps classes with a description only and is NULL
    when none has one.
    """
    shown = {f"__g{i}": pair_code(i) for i in range(SHOWN)}
    out = with_glossary(df, glossary, {"__own": F.col("classe_prevista"), **shown}, bound)
    texts = F.array(
        *[
            F.struct(F.col(f"{n}.code").alias("class"), F.col(f"{n}.description").alias("description"))
            for n in shown
        ]
    )
    known = F.filter(texts, lambda t: t["description"].isNotNull())
    return (
        out.withColumn("situacao_afericao", F.col("__own.situacao_label"))
        .withColumn("dsc_classe_prevista", F.col("__own.description"))
        .withColumn("dsc_predict_proba", F.when(F.size(known) > 0, known))
        .drop("__own", *shown)
    )


RESPONSE_FIELDS = (
    "numero_laudo",
    "classe_prevista",
    "dsc_classe_prevista",
    "camada",
    "situacao_afericao",
    "resultado",
    "resultado_detalhado",
    "predict_proba",
    "dsc_predict_proba",
    "revisao_llm",
)


def response(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The ten response fields, after ``keep`` (such as the line number)."""
    out = df if "revisao_llm" in df.columns else df.withColumn("revisao_llm", F.lit(None).cast("string"))
    proba = F.when(F.size("predict_proba") > 0, F.col("predict_proba")).alias("predict_proba")
    return out.select(*keep, *[proba if c == "predict_proba" else F.col(c) for c in RESPONSE_FIELDS])
