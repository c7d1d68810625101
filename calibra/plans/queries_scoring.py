"""Queries on validation, scoring, review, glossary and history."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from calibra.contracts import record
from calibra.operators import classes, glossary, history, metrics, review, score
from calibra.operators.features import FeatureGroups, fit_features
from calibra.operators.split import prepare_split
from calibra.operators.training import build_registry, fit_classifier
from calibra.operators.validate import validate_rows
from calibra.config import PreparePolicy, TrainPolicy
from calibra.plans.queries_classes import DIST, EVENTS
from calibra.plans.queries_metrics import QUICK, SCORED, _THREE, _class_sql
from calibra.plans.registry import Source, load, query, tag
from calibra.plans.scoring import Scorer
from calibra.session import scratch_path

# --- validation --------------------------------------------------------------------

CONTRACT = record(
    "o_orderkey BIGINT NOT NULL, o_custkey BIGINT NOT NULL, o_totalprice DOUBLE, o_orderstatus STRING NOT NULL, urgent BOOLEAN"
)
CELLS = Source(
    "orders",
    (
        "CAST(o_orderkey AS VARCHAR(20)) AS o_orderkey",
        "CASE WHEN o_orderkey % 11 = 0 THEN 'abc' WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 15 = 0 THEN '12.5' "
        "WHEN o_orderkey % 16 = 0 THEN concat(' ', CAST(o_custkey AS VARCHAR(20)), '.0') ELSE CAST(o_custkey AS VARCHAR(20)) END AS o_custkey",
        "CASE WHEN o_orderkey % 17 = 0 THEN 'x1' WHEN o_orderkey % 18 = 0 THEN NULL WHEN o_orderkey % 20 = 0 THEN '1.5e3' "
        "ELSE CAST(o_totalprice AS VARCHAR(30)) END AS o_totalprice",
        "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus",
        "CASE WHEN o_orderkey % 23 = 0 THEN 'maybe' WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'off' END AS urgent",
    ),
)
_INT_OK = "regexp_matches({c}, '^\\s*[+-]?[0-9]+(\\.0*)?\\s*$')"
_NUM_OK = "regexp_matches({c}, '^\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*$')"
_CHECKED = f"""WITH t AS {CELLS.sql}, e AS (SELECT *,
    CASE WHEN o_orderkey IS NULL THEN 'int_type' WHEN NOT {_INT_OK.format(c='o_orderkey')} THEN 'int_parsing' END AS e1,
    CASE WHEN o_custkey IS NULL THEN 'int_type' WHEN NOT {_INT_OK.format(c='o_custkey')} THEN 'int_parsing' END AS e2,
    CASE WHEN o_totalprice IS NOT NULL AND NOT {_NUM_OK.format(c='o_totalprice')} THEN 'float_parsing' END AS e3,
    CASE WHEN o_orderstatus IS NULL THEN 'string_type' END AS e4,
    CASE WHEN urgent IS NOT NULL AND lower(urgent) NOT IN ('1','0','true','false','t','f','yes','no','y','n','on','off')
        THEN 'bool_parsing' END AS e5 FROM t) """


@query(
    "validate_rows",
    _CHECKED
    + """SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(regexp_replace(trim(o_custkey), '\\.0*$', '') AS BIGINT) AS o_custkey,
    CAST(o_totalprice AS DOUBLE) AS o_totalprice, o_orderstatus, lower(urgent) IN ('1','true','t','yes','y','on') AS urgent
    FROM e WHERE e1 IS NULL AND e2 IS NULL AND e3 IS NULL AND e4 IS NULL AND e5 IS NULL""",
)
def valid_rows(spark, sf_dir):
    return validate_rows(CELLS.load(spark, sf_dir), CONTRACT)[0]


@query(
    "validation_errors",
    _CHECKED
    + " UNION ALL ".join(
        f"SELECT o_orderkey AS line, {tag(f)} AS field, {e} AS reason FROM e WHERE {e} IS NOT NULL"
        for f, e in zip(("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "urgent"), ("e1", "e2", "e3", "e4", "e5"))
    ),
)
def validation_errors(spark, sf_dir):
    cells = CELLS.load(spark, sf_dir).withColumn("line", F.col("o_orderkey"))
    return validate_rows(cells, CONTRACT, "line")[1]


# --- scored records ------------------------------------------------------------------

LABELS = ("0", "1", "2", "30")
_RAW = [
    f"CAST((1 + (o_orderkey * {2 * i + 3} + o_custkey * {i + 1}) % 97) "
    + ("* CASE WHEN o_custkey % 9 = 0 THEN 60 ELSE 1 END" if i == 0 else "")
    + " AS DOUBLE)"
    for i in range(4)
]
_SUM = " + ".join(_RAW)
RECORDS = Source(
    "orders",
    (
        "o_orderkey",
        "CAST(o_custkey AS VARCHAR(20)) AS numero_laudo",
        "o_orderstatus",
        "CASE WHEN o_orderkey % 6 = 0 THEN '  ' ELSE concat(' ', o_orderpriority) END AS o_orderpriority",
        "CASE WHEN o_orderkey % 5 = 0 THEN repeat(concat(o_orderpriority, ' it''s '), 30) WHEN o_orderkey % 4 = 0 THEN NULL "
        "ELSE 'short remark' END AS remark",
        "CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST((o_orderkey + o_custkey) % 4 AS INT) END AS prediction",
        *[f"{raw} / ({_SUM}) AS p{i}" for i, raw in enumerate(_RAW)],
    ),
)
SNAPSHOT = ("o_orderstatus", "not_there", "o_orderpriority", "remark")

_LABEL_SQL = "CASE prediction WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '30' END"
_PAIRS_SQL = " UNION ALL ".join(
    f"SELECT o_orderkey, {i} AS at, {tag(c)} AS class, p{i} AS proba FROM t" for i, c in enumerate(LABELS)
)

GLOSSARY = Source(
    "part",
    (
        "p_partkey",
        "CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE p_size END AS code",
        "CASE WHEN p_size % 5 = 0 THEN '  ' WHEN p_size % 7 = 0 THEN concat(CAST(p_size AS VARCHAR(5)), ' ') ELSE p_name END AS text",
        "CASE p_size % 4 WHEN 0 THEN 'a' WHEN 1 THEN ' R ' WHEN 2 THEN 'X' END AS mark",
    ),
)
_GLOSSARY_SQL = f"""gs AS {GLOSSARY.sql}, g1 AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY p_partkey) AS rn FROM gs
        WHERE code IS NOT NULL),
    g2 AS (SELECT CAST(code AS VARCHAR) AS code, CASE WHEN trim(text) NOT IN ('', CAST(code AS VARCHAR)) THEN trim(text) END AS description,
        CASE WHEN upper(trim(mark)) IN ('A', 'R') THEN upper(trim(mark)) END AS situacao_codigo FROM g1 WHERE rn = 1),
    glossary AS (SELECT code, description AS label, description, situacao_codigo,
        CASE situacao_codigo WHEN 'A' THEN 'Aprovado' WHEN 'R' THEN 'Reprovado' END AS situacao_label,
        CASE WHEN description IS NULL THEN 'pendente' ELSE 'confirmado' END AS status, q.tier
        FROM g2 LEFT JOIN (SELECT class, tier FROM kept) q ON q.class = g2.code) """

_SCORED_SQL = (
    DIST
    + f""", t AS {RECORDS.sql}, own AS (SELECT *, {_LABEL_SQL} AS classe_prevista FROM t), pairs AS ({_PAIRS_SQL}),
    ranked AS (SELECT o.o_orderkey, o.classe_prevista, p.class, p.proba, p.at, p.class IS NOT DISTINCT FROM o.classe_prevista AS is_own,
        MAX(CASE WHEN p.class = o.classe_prevista THEN p.proba END) OVER (PARTITION BY o.o_orderkey) AS own_proba,
        row_number() OVER (PARTITION BY o.o_orderkey ORDER BY (p.class IS NOT DISTINCT FROM o.classe_prevista) DESC, p.proba DESC, p.at) AS place
        FROM own o JOIN pairs p USING (o_orderkey)),
    shown AS (SELECT * FROM ranked WHERE CASE WHEN own_proba >= 0.9 THEN is_own ELSE place <= 3 END),
    res AS (SELECT o.*, COALESCE(kept.tier, 'D') AS camada, kept.weight AS peso,
        (SELECT MAX(proba) FROM shown s WHERE s.o_orderkey = o.o_orderkey AND s.is_own) AS probabilidade
        FROM own o LEFT JOIN kept ON kept.class = o.classe_prevista),
    texts AS (SELECT *, CASE WHEN camada = 'D' THEN 'Revisão manual' ELSE concat('Classe ', classe_prevista, ' (camada ', camada, ')') END AS resultado,
        concat_ws(' ', CASE WHEN camada = 'D' THEN concat('Classe prevista ', COALESCE(classe_prevista, 'null'),
            ' está fora do escopo do registry (camada D) ou não consta em class_weight_registry.json. Recomenda-se revisão manual do laudo.')
        ELSE concat('Classe prevista: ', classe_prevista, ' (camada ', camada, '). ', CASE camada WHEN 'A' THEN {tag(score.TIER_TEXTS["A"])}
            WHEN 'B' THEN {tag(score.TIER_TEXTS["B"])} ELSE {tag(score.TIER_TEXTS["C"])} END,
            ' Peso balanceado da classe no treino: ', printf('%.6f', peso), '.') END,
        CASE WHEN probabilidade IS NOT NULL THEN concat('Probabilidade da classe prevista (predict_proba): ', printf('%.4f', probabilidade), '.') END
        ) AS resultado_detalhado FROM res) """
)


def _records(spark, sf_dir):
    df = RECORDS.load(spark, sf_dir)
    pairs = score.proba_pairs(F.array(*[F.lit(c) for c in LABELS]), F.array("p0", "p1", "p2", "p3"))
    return score.decode_label(df.withColumn("predict_proba", pairs), list(LABELS))


def _registry(spark, sf_dir):
    return classes.class_registry(EVENTS.load(spark, sf_dir), "k")


def _results(spark, sf_dir):
    return score.add_results(_records(spark, sf_dir), _registry(spark, sf_dir), bound=classes.retained_bound(0.1))


def _glossary(spark, sf_dir):
    return glossary.build_glossary(GLOSSARY.load(spark, sf_dir), "p_partkey", _registry(spark, sf_dir), ("code", "text", "mark"))


@query("proba_long", f"WITH t AS {RECORDS.sql} SELECT o_orderkey, class, proba FROM ({_PAIRS_SQL}) p")
def proba_long(spark, sf_dir):
    return _records(spark, sf_dir).select("o_orderkey", F.inline("predict_proba"))


@query(
    "proba_trim",
    _SCORED_SQL + "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY place) AS INT) AS place, class, proba FROM shown",
)
def proba_trim(spark, sf_dir):
    df = _records(spark, sf_dir)
    trimmed = score.trim_pairs(F.col("predict_proba"), F.col("classe_prevista"))
    return df.select("o_orderkey", F.posexplode(trimmed).alias("at", "x")).select(
        "o_orderkey", (F.col("at") + 1).alias("place"), "x.class", "x.proba"
    )


@query("decode_label", f"SELECT o_orderkey, prediction, {_LABEL_SQL} AS classe_prevista FROM {RECORDS.sql} t")
def decode(spark, sf_dir):
    return _records(spark, sf_dir).select("o_orderkey", "prediction", "classe_prevista")


@query("tier_lookup", _SCORED_SQL + "SELECT o_orderkey, classe_prevista, camada, peso FROM res")
def tier_lookup(spark, sf_dir):
    out = score.tier_lookup(_records(spark, sf_dir), _registry(spark, sf_dir), bound=classes.retained_bound(0.1))
    return out.select("o_orderkey", "classe_prevista", "camada", "peso")


@query("result_text", _SCORED_SQL + "SELECT o_orderkey, resultado FROM texts")
def result_text(spark, sf_dir):
    return _results(spark, sf_dir).select("o_orderkey", "resultado")


@query("result_detail", _SCORED_SQL + "SELECT o_orderkey, resultado_detalhado FROM texts")
def result_detail(spark, sf_dir):
    return _results(spark, sf_dir).select("o_orderkey", "resultado_detalhado")


@query(
    "glossary_build",
    DIST + f", {_GLOSSARY_SQL} SELECT * FROM glossary",
)
def glossary_build(spark, sf_dir):
    return _glossary(spark, sf_dir)


@query(
    "glossary_counts",
    DIST
    + f""", {_GLOSSARY_SQL} SELECT COUNT(*) AS classes, COUNT(*) FILTER (status = 'confirmado') AS confirmed,
    COUNT(*) FILTER (status = 'pendente') AS pending, COUNT(*) FILTER (situacao_codigo = 'A') AS approved,
    COUNT(*) FILTER (situacao_codigo = 'R') AS rejected FROM glossary""",
)
def glossary_counts(spark, sf_dir):
    return glossary.glossary_counts(_glossary(spark, sf_dir))


@query(
    "glossary_enrich",
    _SCORED_SQL
    + f""", {_GLOSSARY_SQL}, described AS (SELECT s.o_orderkey, string_agg(concat(s.class, '=', g.description), '; ' ORDER BY s.place) AS texts
        FROM shown s JOIN glossary g ON g.code = s.class WHERE g.description IS NOT NULL GROUP BY 1)
    SELECT res.o_orderkey, g.situacao_label AS situacao_afericao, g.description AS dsc_classe_prevista, d.texts AS dsc_predict_proba
    FROM res LEFT JOIN glossary g ON g.code = res.classe_prevista LEFT JOIN described d ON d.o_orderkey = res.o_orderkey""",
)
def glossary_enrich(spark, sf_dir):
    out = score.enrich(_results(spark, sf_dir), _glossary(spark, sf_dir))
    texts = F.transform("dsc_predict_proba", lambda x: F.concat(x["class"], F.lit("="), x["description"]))
    return out.select("o_orderkey", "situacao_afericao", "dsc_classe_prevista", F.array_join(texts, "; ").alias("dsc_predict_proba"))


# --- review ------------------------------------------------------------------------

_TOP_SQL = """, top AS (SELECT o_orderkey, class, proba, row_number() OVER (PARTITION BY o_orderkey ORDER BY proba DESC, place) AS rank FROM shown),
    gaps AS (SELECT o_orderkey, MAX(CASE WHEN rank = 1 THEN proba END) - MAX(CASE WHEN rank = 2 THEN proba END) AS top1_top2_gap
        FROM top GROUP BY 1) """


@query("topk_proba", _SCORED_SQL + _TOP_SQL + "SELECT o_orderkey, CAST(rank AS INT) AS rank, class, proba FROM top")
def topk_proba(spark, sf_dir):
    out = _results(spark, sf_dir).select("o_orderkey", F.posexplode(review.top_pairs(F.col("predict_proba"))).alias("at", "x"))
    return out.select("o_orderkey", (F.col("at") + 1).alias("rank"), "x.class", "x.proba")


@query("top_gap", _SCORED_SQL + _TOP_SQL + "SELECT o_orderkey, round(top1_top2_gap, 9) AS top1_top2_gap FROM gaps")
def top_gap(spark, sf_dir):
    gap = review.top_gap(review.top_pairs(F.col("predict_proba")))
    return _results(spark, sf_dir).select("o_orderkey", F.round(gap, 9).alias("top1_top2_gap"))


_SNAP_SQL = """SELECT o_orderkey, 1 AS pos, 'o_orderstatus' AS key, o_orderstatus AS value FROM t WHERE trim(o_orderstatus) <> ''
    UNION ALL SELECT o_orderkey, 2, 'o_orderpriority', trim(o_orderpriority) FROM t WHERE trim(o_orderpriority) <> ''
    UNION ALL SELECT o_orderkey, 3, 'remark', CASE WHEN length(trim(remark)) > 280 THEN concat(substr(trim(remark), 1, 277), '...')
        ELSE trim(remark) END FROM t WHERE trim(remark) <> ''"""


@query("feature_snapshot", f"WITH t AS {RECORDS.sql} SELECT o_orderkey, key, value FROM ({_SNAP_SQL}) s")
def feature_snapshot(spark, sf_dir):
    df = RECORDS.load(spark, sf_dir)
    return df.select("o_orderkey", F.inline(review.feature_snapshot(df, SNAPSHOT, "remark"))).drop("is_text")


def _class_metrics(spark, sf_dir):
    table = metrics.per_class_metrics(SCORED.load(spark, sf_dir), "truth", "pred", [0, 1, 2])
    tiers = F.when(F.col("class") == 0, F.lit("A")).otherwise(F.lit("B"))
    return table.withColumn("tier", tiers)


def _context(spark, sf_dir):
    return review.review_context(
        _results(spark, sf_dir), _glossary(spark, sf_dir), _class_metrics(spark, sf_dir), class_bound=3, keys=SNAPSHOT, remark="remark"
    )


_LINE_SQL = (
    "CASE WHEN g.code IS NULL THEN concat('CODRSTAFER ', {c}, ': (ausente no glossário) — não inventar significado operacional.') "
    "ELSE concat('CODRSTAFER ', g.code, ': ', COALESCE(g.label, '(rótulo pendente)'), ' — ', "
    "COALESCE(g.description, '(descrição operacional pendente no glossário)'), ' (Situação: ', "
    "COALESCE(g.situacao_label, '(situação não informada)'), ')') END"
)
_LINES_SQL = f""", {_GLOSSARY_SQL}, lines AS (
    SELECT o.o_orderkey, 0 AS rank, {_LINE_SQL.format(c="o.classe_prevista")} AS line FROM own o LEFT JOIN glossary g ON g.code = o.classe_prevista
        WHERE o.classe_prevista IS NOT NULL
    UNION ALL SELECT o.o_orderkey, 0, 'CODRSTAFER null: (ausente no glossário) — não inventar significado operacional.' FROM own o
        WHERE o.classe_prevista IS NULL
    UNION ALL SELECT top.o_orderkey, top.rank, {_LINE_SQL.format(c="top.class")} FROM top JOIN own o USING (o_orderkey)
        LEFT JOIN glossary g ON g.code = top.class WHERE top.class IS DISTINCT FROM o.classe_prevista),
    block AS (SELECT o_orderkey, string_agg(line, chr(10) ORDER BY rank) AS glossary_text FROM lines GROUP BY 1) """


@query("glossary_text", _SCORED_SQL + _TOP_SQL + _LINES_SQL + "SELECT * FROM block")
def glossary_text(spark, sf_dir):
    out = _results(spark, sf_dir).withColumn("topk_proba", review.top_pairs(F.col("predict_proba")))
    return review.add_glossary_text(out, _glossary(spark, sf_dir)).select("o_orderkey", "glossary_text")


_METRICS_SQL = f""", sc AS {SCORED.sql}, {_class_sql('truth', 'pred', _THREE, 'sc')},
    cm AS (SELECT CAST(class AS VARCHAR) AS class, p, r, f, support, CASE WHEN class = 0 THEN 'A' ELSE 'B' END AS tier FROM m) """


@query(
    "review_context",
    _SCORED_SQL
    + _TOP_SQL
    + _LINES_SQL
    + _METRICS_SQL
    + f""", snap AS (SELECT o_orderkey, COUNT(*) AS n FROM ({_SNAP_SQL}) s GROUP BY 1)
    SELECT x.o_orderkey, x.numero_laudo, x.classe_prevista, x.camada, x.peso, x.probabilidade, round(gaps.top1_top2_gap, 9) AS top1_top2_gap,
    round(cm.f, 6) AS f1, cm.support, COALESCE(snap.n, 0) AS features, block.glossary_text
    FROM texts x JOIN gaps USING (o_orderkey) JOIN block USING (o_orderkey) LEFT JOIN cm ON cm.class = x.classe_prevista
    LEFT JOIN snap ON snap.o_orderkey = x.o_orderkey""",
)
def review_context(spark, sf_dir):
    return _context(spark, sf_dir).select(
        "o_orderkey",
        "numero_laudo",
        "classe_prevista",
        "camada",
        "peso",
        "probabilidade",
        F.round("top1_top2_gap", 9).alias("top1_top2_gap"),
        F.round("class_metrics.f1", 6).alias("f1"),
        "class_metrics.support",
        F.size("feature_snapshot").alias("features"),
        "glossary_text",
    )


def _gate_sql(skip_a: bool) -> str:
    first = f"WHEN x.camada = 'A' THEN {tag(review.TIER_A)}" if skip_a else ""
    return f"""gate AS (SELECT x.o_orderkey, CASE {first} WHEN x.camada IN ('B', 'C', 'D') THEN concat('camada ', x.camada, ': revisão LLM recomendada')
        WHEN x.probabilidade < 0.7 THEN concat('probabilidade ', printf('%.4f', x.probabilidade), ' < LLM_MIN_PROBA=0.7')
        WHEN gaps.top1_top2_gap < 0.15 THEN concat('gap top1–top2 ', printf('%.4f', gaps.top1_top2_gap), ' < LLM_MIN_TOP_GAP=0.15')
        ELSE {tag(review.NOT_MET)} END AS reason FROM texts x JOIN gaps USING (o_orderkey)) """


_CALLS = f"reason NOT IN ({tag(review.TIER_A)}, {tag(review.NOT_MET)})"


@query(
    "review_gate",
    _SCORED_SQL + _TOP_SQL + f", {_gate_sql(True)} SELECT o_orderkey, {_CALLS} AS should_call, reason FROM gate",
)
def review_gate(spark, sf_dir):
    out = _results(spark, sf_dir)
    out = out.withColumn("top1_top2_gap", review.top_gap(review.top_pairs(F.col("predict_proba"))))
    return review.review_gate(out).select("o_orderkey", "review.should_call", "review.reason")


@query(
    "review_gate_all_tiers",
    _SCORED_SQL + _TOP_SQL + f", {_gate_sql(False)} SELECT o_orderkey, {_CALLS} AS should_call, reason FROM gate",
)
def review_gate_all_tiers(spark, sf_dir):
    out = _results(spark, sf_dir)
    out = out.withColumn("top1_top2_gap", review.top_gap(review.top_pairs(F.col("predict_proba"))))
    policy = review.ReviewPolicy(skip_tier_a=False)
    return review.review_gate(out, policy).select("o_orderkey", "review.should_call", "review.reason")


_PROMPT_SQL = f"""SELECT x.o_orderkey, printf({tag(review.PROMPT)}, x.numero_laudo, COALESCE(x.classe_prevista, 'null'), x.camada,
    COALESCE(printf('%.6f', x.peso), 'indisponível'), COALESCE(printf('%.4f', x.probabilidade), 'indisponível'), x.resultado, x.resultado_detalhado,
    concat('Top-k predict_proba: ', tops.line, '.', CASE WHEN gaps.top1_top2_gap IS NULL THEN ''
        ELSE concat(' Gap top1–top2: ', printf('%.4f', gaps.top1_top2_gap), '.') END),
    CASE WHEN cm.class IS NULL THEN {tag(review.NO_METRICS)} ELSE concat('Métricas de validação da classe prevista: F1=', printf('%.4f', cm.f),
        ', precision=', printf('%.4f', cm.p), ', recall=', printf('%.4f', cm.r), ', support=', CAST(cm.support AS VARCHAR),
        ', tier_treino=', cm.tier, '.') END,
    'confirmado', block.glossary_text, COALESCE(concat('Snapshot de features do laudo: ', snap.line, '.'), {tag(review.NO_FEATURES)}),
    COALESCE(x.classe_prevista, 'null'), x.camada) AS prompt
    FROM texts x JOIN gaps USING (o_orderkey) JOIN block USING (o_orderkey) JOIN gate USING (o_orderkey) JOIN tops USING (o_orderkey)
    LEFT JOIN cm ON cm.class = x.classe_prevista LEFT JOIN snap ON snap.o_orderkey = x.o_orderkey WHERE {_CALLS}"""


@query(
    "review_prompts",
    _SCORED_SQL
    + _TOP_SQL
    + _LINES_SQL
    + _METRICS_SQL
    + f""", {_gate_sql(True)}, tops AS (SELECT o_orderkey, string_agg(concat(class, '=', printf('%.4f', proba)), ', ' ORDER BY rank) AS line
        FROM top GROUP BY 1),
    snap AS (SELECT o_orderkey, string_agg(concat(key, '=', CASE WHEN contains(value, chr(39)) THEN concat('"', value, '"')
        ELSE concat(chr(39), value, chr(39)) END), ', ' ORDER BY pos) AS line FROM ({_SNAP_SQL}) s GROUP BY 1) """
    + _PROMPT_SQL,
)
def review_prompts(spark, sf_dir):
    return review.review_prompts(_context(spark, sf_dir), "o_orderkey")


REVIEWS = Source("orders", ("o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN concat('text on ', o_orderpriority) END AS review_text"))


@query(
    "review_merge",
    _SCORED_SQL
    + f""", v AS {REVIEWS.sql} SELECT x.o_orderkey, classe_prevista, camada, probabilidade, v.review_text AS revisao_llm
    FROM texts x LEFT JOIN v USING (o_orderkey)""",
)
def review_merge(spark, sf_dir):
    out = review.merge_reviews(_results(spark, sf_dir), REVIEWS.load(spark, sf_dir), "o_orderkey")
    return out.select("o_orderkey", "classe_prevista", "camada", "probabilidade", "revisao_llm")


# --- batch scoring and history -------------------------------------------------------


@query("batch_score")
def batch_score(spark, sf_dir):
    df = load(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", (F.col("o_custkey") % 10).alias("group_no"), "o_orderpriority", "o_orderstatus"
    )
    fitted = fit_features(df, FeatureGroups(["o_totalprice", "group_no"], ["o_orderpriority"], []), PreparePolicy(enable_reduction=False))
    frame = prepare_split(fitted.transform(df), TrainPolicy(target="o_orderstatus"), ["o_orderkey"])
    model = fit_classifier(build_registry(42, 3, QUICK)["logreg"], frame.filter(~F.col("is_test")))
    names = [str(r["o_orderstatus"]) for r in frame.select("o_orderstatus", "label").distinct().orderBy("label").collect()]
    scorer = Scorer(
        fitted.model, model, names, classes.class_registry(df, "o_orderstatus"), _glossary(spark, sf_dir),
        ("o_totalprice", "group_no", "o_orderpriority"), "o_orderkey",
    )
    return score.response(scorer.score(df.drop("o_orderstatus")), ("o_orderkey",))


HISTORY = Source(
    "events",
    ("CAST(event_id AS VARCHAR(20)) AS id", "CAST(user_id AS VARCHAR(20)) AS numero_laudo", "event_type AS classe_prevista", "ts AS criado_em"),
)


@query(
    "history_append",
    _SCORED_SQL
    + """SELECT usuario_id, camada, COUNT(*) AS rows, COUNT(*) AS ids FROM texts, (SELECT 'first' AS usuario_id UNION ALL SELECT 'second') u
    GROUP BY usuario_id, camada""",
)
def history_append(spark, sf_dir):
    path = scratch_path(spark, "history")
    rows = _results(spark, sf_dir).select("numero_laudo", "classe_prevista", "camada", "resultado")
    history.append_history(rows, path, "first")
    history.append_history(rows, path, "second")
    stored = history.read_history(spark, path)
    return stored.groupBy("usuario_id", "camada").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"))


@query(
    "history_query",
    f"""SELECT * FROM {HISTORY.sql} t WHERE numero_laudo = '7' AND criado_em >= TIMESTAMP '2024-01-03 00:00:00'
    AND criado_em <= TIMESTAMP '2024-01-20 12:00:00' ORDER BY criado_em DESC, id LIMIT 50""",
)
def history_query(spark, sf_dir):
    return history.query_history(
        HISTORY.load(spark, sf_dir), "7", datetime(2024, 1, 3), datetime(2024, 1, 20, 12)
    )


@query(
    "history_latest",
    f"SELECT * FROM {HISTORY.sql} t WHERE numero_laudo = '7' ORDER BY criado_em DESC, id LIMIT 50",
)
def history_latest(spark, sf_dir):
    return history.query_history(HISTORY.load(spark, sf_dir), "7")


