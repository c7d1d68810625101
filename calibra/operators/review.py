"""Review context, gate, prompts and merge. The reviewer itself is external."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.config import DEFAULT_REVIEW, DEFAULT_TIERS, ReviewPolicy
from calibra.contracts import REMARK_KEY, SNAPSHOT_KEYS
from calibra.functions.text import fixed, strip
from calibra.operators.score import SHOWN, sort_pairs, with_glossary
from calibra.session import small_side

TOP_K = 5
# Longest remark, and its length once shortened.
REMARK_LIMIT = 280
REMARK_KEPT = 277

# Gate reasons.
FORCED = "forçado via parâmetro revisao_llm=true"
REFUSED = "desabilitado via parâmetro revisao_llm=false"
DISABLED = "LLM_ENABLED=false"
UNCONFIGURED = "provedor %s sem API key configurada"
TIER_A = "camada A (classe majoritária): LLM omitido por default (LLM_SKIP_TIER_A)"
TIER_YES = "camada %s: revisão LLM recomendada"
LOW_PROBA = "probabilidade %s < LLM_MIN_PROBA=%s"
LOW_GAP = "gap top1–top2 %s < LLM_MIN_TOP_GAP=%s"
NOT_MET = "critérios de gate não atendidos"

# Glossary lines.
ENTRY_LINE = "CODRSTAFER %s: %s — %s (Situação: %s)"
ABSENT_LINE = "CODRSTAFER %s: (ausente no glossário) — não inventar significado operacional."
PENDING_LABEL = "(rótulo pendente)"
PENDING_DESCRIPTION = "(descrição operacional pendente no glossário)"
PENDING_SITUATION = "(situação não informada)"

# Prompt texts.
NO_METRICS = "Métricas por classe: indisponíveis neste request."
EMPTY_METRICS = "Métricas por classe: presentes, porém sem valores numéricos."
METRICS_LINE = "Métricas de validação da classe prevista: %s."
NO_TOP = "Distribuição predict_proba: indisponível."
TOP_LINE = "Top-k predict_proba: %s."
GAP_PART = " Gap top1–top2: %s."
NO_FEATURES = "Snapshot de features do laudo: vazio."
FEATURES_LINE = "Snapshot de features do laudo: %s."
NO_GLOSSARY = "Glossário CODRSTAFER: sem entradas para as classes deste request."
NOT_AVAILABLE = "indisponível"
NO_NUMBER = "não informado"
PROMPT = """\
## Evidências estruturadas (não alterar)

- Número do laudo: %s
- Classe prevista (CODRSTAFER): %s
- Camada de qualificação: %s
- Peso balanceado no treino: %s
- Probabilidade da classe prevista: %s
- Resultado resumido (template): %s
- Resultado detalhado (template factual): %s

%s
%s

## Glossário CODRSTAFER (status=%s)
%s

%s

## Tarefa
Com base EXCLUSIVAMENTE nas evidências acima, redija a revisão em português do \
Brasil para o campo de análise textual do laudo. Lembre-se: a classe \
%s (camada %s) é a fonte da verdade.
"""


def top_pairs(pairs: Column, k: int = TOP_K) -> Column:
    """The ``k`` (at least one) most probable of the classes already shown."""
    return F.slice(sort_pairs(pairs), 1, max(1, k))


def top_gap(top: Column) -> Column:
    """Difference of the two highest probabilities, NULL with fewer than two."""
    return F.get(top, F.lit(0)).getField("proba") - F.get(top, F.lit(1)).getField("proba")


def feature_snapshot(df: DataFrame, keys: tuple[str, ...] = SNAPSHOT_KEYS, remark: str = REMARK_KEY) -> Column:
    """Array of ``(key, value, is_text)`` without null and blank values, in key order."""
    items = []
    for key in keys:
        if key not in df.columns:
            continue
        is_text = df.schema[key].dataType.simpleString() == "string"
        value = strip(F.col(key).cast("string"))
        if key == remark:
            short = F.concat(F.substring(value, 1, REMARK_KEPT), F.lit("..."))
            value = F.when(F.length(value) > REMARK_LIMIT, short).otherwise(value)
        items.append(F.struct(F.lit(key).alias("key"), value.alias("value"), F.lit(is_text).alias("is_text")))
    if not items:
        return F.array().cast("array<struct<key:string,value:string,is_text:boolean>>")
    return F.filter(F.array(*items), lambda x: x["value"].isNotNull() & (x["value"] != ""))


def entry_line(code: Column, entry: Column) -> Column:
    """One glossary line; a code without entry gets the absent line."""
    filled = lambda name, default: F.coalesce(F.nullif(entry.getField(name), F.lit("")), F.lit(default))
    line = F.format_string(
        ENTRY_LINE,
        entry.getField("code"),
        filled("label", PENDING_LABEL),
        filled("description", PENDING_DESCRIPTION),
        filled("situacao_label", PENDING_SITUATION),
    )
    return F.when(entry.getField("code").isNull(), F.format_string(ABSENT_LINE, code)).otherwise(line)


def add_glossary_text(df: DataFrame, glossary: DataFrame, bound: float | None = None) -> DataFrame:
    """Add ``glossary_text``: the predicted class first, then the other top classes."""
    codes = {f"__t{i}": F.get("topk_proba", F.lit(i)).getField("class") for i in range(SHOWN)}
    out = with_glossary(df, glossary, {"__own": F.col("classe_prevista"), **codes}, bound)
    lines = [entry_line(F.col("classe_prevista"), F.col("__own"))]
    for name, code in codes.items():
        lines.append(
            F.when(code.isNotNull() & ~code.eqNullSafe(F.col("classe_prevista")), entry_line(code, F.col(name)))
        )
    return out.withColumn("glossary_text", F.concat_ws("\n", *lines)).drop("__own", *codes)


def review_context(
    df: DataFrame, glossary: DataFrame, class_metrics: DataFrame | None = None, glossary_status: str = "confirmado",
    class_bound: float | None = None, glossary_bound: float | None = None,
    keys: tuple[str, ...] = SNAPSHOT_KEYS, remark: str = REMARK_KEY,
) -> DataFrame:
    """Evidence columns for each scored row (see ``add_results``).

    ``class_metrics`` has ``class, precision, recall, f1, support, tier`` keyed
    by the original label; without it the metrics are NULL.
    """
    out = df.withColumn("topk_proba", top_pairs(F.col("predict_proba")))
    out = out.withColumn("top1_top2_gap", top_gap(F.col("topk_proba")))
    out = out.withColumn("feature_snapshot", feature_snapshot(df, keys, remark))
    if class_metrics is None:
        empty = "struct<precision:double,recall:double,f1:double,support:bigint,tier:string>"
        out = out.withColumn("class_metrics", F.lit(None).cast(empty))
    else:
        side = class_metrics.select(
            F.col("class").cast("string").alias("__class"),
            F.struct("precision", "recall", "f1", F.col("support").cast("long").alias("support"), "tier").alias("class_metrics"),
        )
        out = out.join(small_side(side, class_bound), F.col("classe_prevista") == F.col("__class"), "left").drop("__class")
    return add_glossary_text(out, glossary, glossary_bound).withColumn("glossary_status", F.lit(glossary_status))


def review_gate(
    df: DataFrame, policy: ReviewPolicy = DEFAULT_REVIEW, force: bool | None = None,
    discard: str = DEFAULT_TIERS.discard_label,
) -> DataFrame:
    """Add ``review = struct<should_call, reason>``; the first rule that holds wins."""

    def decision(call: bool, reason: Column) -> Column:
        return F.struct(F.lit(call).alias("should_call"), reason.alias("reason"))

    if force is not None:
        return df.withColumn("review", decision(force, F.lit(FORCED if force else REFUSED)))
    if not policy.enabled:
        return df.withColumn("review", decision(False, F.lit(DISABLED)))
    if not policy.configured:
        return df.withColumn("review", decision(False, F.lit(UNCONFIGURED % policy.provider)))
    tier = F.upper(F.coalesce("camada", F.lit("")))
    proba, gap = F.col("probabilidade"), F.col("top1_top2_gap")
    low_proba = F.format_string(LOW_PROBA, fixed(proba, 4), F.lit(str(policy.min_proba)))
    low_gap = F.format_string(LOW_GAP, fixed(gap, 4), F.lit(str(policy.min_top_gap)))
    rule = F.when(F.lit(policy.skip_tier_a) & (tier == "A"), decision(False, F.lit(TIER_A)))
    rule = rule.when(tier.isin("B", "C", discard), decision(True, F.format_string(TIER_YES, tier)))
    rule = rule.when(proba < policy.min_proba, decision(True, low_proba))
    rule = rule.when(gap < policy.min_top_gap, decision(True, low_gap))
    return df.withColumn("review", rule.otherwise(decision(False, F.lit(NOT_MET))))


def _quoted(value: Column) -> Column:
    """Text in quotes with the usual escapes; double quotes if it holds a single one."""
    text = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    single, double = F.instr(value, "'") > 0, F.instr(value, '"') > 0
    plain = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(single & ~double, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(plain)


def _top_line() -> Column:
    items = F.array_join(
        F.transform("topk_proba", lambda x: F.concat(x["class"], F.lit("="), fixed(x["proba"], 4))), ", "
    )
    gap = F.coalesce(F.format_string(GAP_PART, fixed(F.col("top1_top2_gap"), 4)), F.lit(""))
    gap = F.when(F.col("top1_top2_gap").isNotNull(), gap).otherwise(F.lit(""))
    return F.when(F.size("topk_proba") > 0, F.concat(F.format_string(TOP_LINE, items), gap)).otherwise(F.lit(NO_TOP))


def _metrics_line() -> Column:
    m = F.col("class_metrics")
    number = lambda name, text: F.when(
        m.getField(name).isNotNull(), F.concat(F.lit(f"{text}="), fixed(m.getField(name), 4))
    )
    parts = F.concat_ws(
        ", ",
        number("f1", "F1"),
        number("precision", "precision"),
        number("recall", "recall"),
        F.concat(F.lit("support="), m.getField("support").cast("string")),
        F.concat(F.lit("tier_treino="), m.getField("tier")),
    )
    return (
        F.when(m.isNull(), F.lit(NO_METRICS))
        .when(parts == "", F.lit(EMPTY_METRICS))
        .otherwise(F.format_string(METRICS_LINE, parts))
    )


def _features_line() -> Column:
    items = F.transform(
        "feature_snapshot",
        lambda x: F.concat(x["key"], F.lit("="), F.when(x["is_text"], _quoted(x["value"])).otherwise(x["value"])),
    )
    line = F.format_string(FEATURES_LINE, F.array_join(items, ", "))
    return F.when(F.size("feature_snapshot") > 0, line).otherwise(F.lit(NO_FEATURES))


def review_prompt() -> Column:
    """Prompt text from the context columns."""
    weight = F.when(F.col("peso").isNotNull(), fixed(F.col("peso"), 6)).otherwise(F.lit(NOT_AVAILABLE))
    proba = F.when(F.col("probabilidade").isNotNull(), fixed(F.col("probabilidade"), 4)).otherwise(F.lit(NOT_AVAILABLE))
    return F.format_string(
        PROMPT,
        F.coalesce(F.nullif(F.col("numero_laudo").cast("string"), F.lit("")), F.lit(NO_NUMBER)),
        F.col("classe_prevista"),
        F.col("camada"),
        weight,
        proba,
        F.col("resultado"),
        F.col("resultado_detalhado"),
        _top_line(),
        _metrics_line(),
        F.col("glossary_status"),
        F.coalesce(F.nullif(F.col("glossary_text"), F.lit("")), F.lit(NO_GLOSSARY)),
        _features_line(),
        F.col("classe_prevista"),
        F.col("camada"),
    )


def review_prompts(context: DataFrame, key: str, policy: ReviewPolicy = DEFAULT_REVIEW, force: bool | None = None) -> DataFrame:
    """Export table ``(key, prompt)`` of the rows the gate lets through."""
    gated = review_gate(context, policy, force).filter("review.should_call")
    return gated.select(key, review_prompt().alias("prompt"))


def merge_reviews(scored: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """Attach external texts as ``revisao_llm``; no other field changes, no row is lost."""
    texts = reviews.groupBy(F.col(key).alias("__key")).agg(F.min("review_text").alias("revisao_llm"))
    return scored.drop("revisao_llm").join(texts, F.col(key) == F.col("__key"), "left").drop("__key")
