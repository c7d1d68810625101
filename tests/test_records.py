"""Contracts, validation, scoring texts, review, glossary, history."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibra import contracts
from calibra.config import ReviewPolicy
from calibra.operators import glossary, history, review, score
from calibra.operators.classes import registry_document
from calibra.operators.validate import ContractError, validate_batch, validate_rows
from calibra.sources.artifacts import write_registry

CONTRACT = contracts.record("n BIGINT NOT NULL, x DOUBLE, s STRING NOT NULL, b BOOLEAN")


def test_contract_sizes():
    assert len(contracts.FULL_RECORD) == 83 and len(contracts.FEATURE_RECORD) == 24
    assert len(contracts.DENY_LIST) == 30 and len(contracts.SNAPSHOT_KEYS) == 14
    assert contracts.FULL_RECORD["NUMLAUDO"] == T.StructField("NUMLAUDO", T.LongType(), False)
    assert contracts.TARGET not in contracts.FULL_RECORD.fieldNames()
    assert set(contracts.FEATURE_COLUMNS) <= set(contracts.FULL_RECORD.fieldNames())


def test_valid_rows_are_typed(spark):
    cells = spark.createDataFrame([(1, " 7.0 ", "1e2", "a", "Yes"), (2, "8", None, "", "off")], "line int, n string, x string, s string, b string")
    valid, errors = validate_rows(cells, CONTRACT, "line")
    assert [tuple(r) for r in valid.orderBy("line").collect()] == [(1, 7, 100.0, "a", True), (2, 8, None, "", False)]
    assert errors.count() == 0 and valid.schema["n"].dataType == T.LongType()


def test_all_errors_of_all_rows(spark):
    cells = spark.createDataFrame(
        [(1, "7", "1", "a", "1"), (2, "7.5", "zz", None, "?"), (3, None, None, "b", None)],
        "line int, n string, x string, s string, b string",
    )
    with pytest.raises(ContractError) as caught:
        validate_batch(cells, CONTRACT, "line")
    got = sorted(tuple(r) for r in caught.value.errors.collect())
    assert got == [
        (2, "b", "bool_parsing"), (2, "n", "int_parsing"), (2, "s", "string_type"), (2, "x", "float_parsing"), (3, "n", "int_type"),
    ]


def test_missing_and_extra_columns(spark):
    cells = spark.createDataFrame([("1", "q")], "n string, more string")
    errors = sorted(tuple(r) for r in validate_rows(cells, CONTRACT)[1].collect())
    assert errors == [("more", "extra_forbidden"), ("s", "missing")]


def test_big_numbers_do_not_overflow(spark):
    cells = spark.createDataFrame([("9" * 30, "1", "a", "1")], "n string, x string, s string, b string")
    assert [tuple(r) for r in validate_rows(cells, CONTRACT)[1].collect()] == [("n", "int_parsing")]


def trimmed(spark, probabilities, predicted, classes=("10", "1", "2", "3"), **options):
    pairs = score.proba_pairs(F.array(*[F.lit(c) for c in classes]), F.array(*[F.lit(p) for p in probabilities]))
    out = spark.range(1).select(score.trim_pairs(pairs, F.lit(predicted), **options).alias("t")).first().t
    return [(x["class"], x.proba) for x in out]


def test_trim_cases(spark):
    assert trimmed(spark, [0.95, 0.05], "10") == [("10", 0.95)]
    assert trimmed(spark, [0.6, 0.4], "10") == [("10", 0.6), ("1", 0.4)]
    assert trimmed(spark, [0.4, 0.3, 0.2, 0.1], "10") == [("10", 0.4), ("1", 0.3), ("2", 0.2)]
    assert trimmed(spark, [0.4, 0.3, 0.2, 0.1], "2") == [("2", 0.2), ("10", 0.4), ("1", 0.3)]
    assert trimmed(spark, [0.4, 0.3, 0.2, 0.1], "zz") == [("10", 0.4), ("1", 0.3), ("2", 0.2)]
    assert trimmed(spark, [0.25, 0.25, 0.25, 0.25], "3") == [("3", 0.25), ("10", 0.25), ("1", 0.25)]
    assert trimmed(spark, [0.6, 0.4], "10", limit=0.5) == [("10", 0.6)]


def test_confidence_setting():
    assert [score.confidence_limit(v) for v in (None, " ", "x", "0.5")] == [0.9, 0.9, 0.9, 0.5]


def test_decode(spark):
    df = spark.createDataFrame([(0,), (1,)], "prediction int")
    assert [r.classe_prevista for r in score.decode_label(df, ["a", "b"]).collect()] == ["a", "b"]
    for bad in (-1, 2):
        with pytest.raises(Exception, match="outside the class list"):
            score.decode_label(spark.createDataFrame([(bad,)], "prediction int"), ["a", "b"]).collect()


@pytest.fixture(scope="module")
def scored(spark):
    registry = spark.createDataFrame([("10", "A", 0.15), ("1", "B", 0.2)], "class string, tier string, weight double")
    pair = "array<struct<class:string,proba:double>>"
    rows = [
        (1, "10", [("10", 0.8), ("1", 0.2)]),
        (2, "1", [("10", 0.45), ("1", 0.55)]),
        (3, "99", [("10", 0.5), ("1", 0.3), ("99", 0.2)]),
        (4, "10", []),
    ]
    df = spark.createDataFrame(rows, f"numero_laudo int, classe_prevista string, predict_proba {pair}")
    return score.add_results(df, registry).cache()


@pytest.fixture(scope="module")
def entries(spark):
    rows = [("10", "ok text", "ok text", "A", "Aprovado", "confirmado", None), ("1", None, None, "R", "Reprovado", "pendente", None)]
    return spark.createDataFrame(rows, glossary.SCHEMA)


def test_result_texts(scored):
    got = {r.numero_laudo: r for r in scored.collect()}
    assert got[1].resultado == "Classe 10 (camada A)"
    assert "0.150000" in got[1].resultado_detalhado and "0.8000" in got[1].resultado_detalhado
    assert (got[3].camada, got[3].peso, got[3].resultado) == ("D", None, "Revisão manual")
    assert got[3].resultado_detalhado.endswith("(predict_proba): 0.2000.")
    assert "predict_proba" not in got[4].resultado_detalhado


def test_enrichment(scored, entries):
    got = {r.numero_laudo: r for r in score.enrich(scored, entries).collect()}
    assert (got[1].situacao_afericao, got[1].dsc_classe_prevista) == ("Aprovado", "ok text")
    assert [(d["class"], d.description) for d in got[2].dsc_predict_proba] == [("10", "ok text")]
    assert got[3].situacao_afericao is None and got[4].dsc_predict_proba is None


def test_response_fields(scored, entries):
    out = score.response(score.enrich(scored, entries))
    assert out.columns == list(score.RESPONSE_FIELDS)
    assert out.filter("numero_laudo = 4").first().predict_proba is None


def gate(spark, tier, proba=0.9, gap=0.5, policy=ReviewPolicy(), force=None):
    df = spark.createDataFrame([(tier, proba, gap)], "camada string, probabilidade double, top1_top2_gap double")
    row = review.review_gate(df, policy, force).first().review
    return row.should_call, row.reason


def test_gate_truth_table(spark):
    assert gate(spark, "A")[0] is False
    assert [gate(spark, t)[0] for t in "BCD"] == [True] * 3
    assert gate(spark, "A", force=True) == (True, review.FORCED)
    assert gate(spark, "C", force=False) == (False, review.REFUSED)
    assert gate(spark, "B", policy=ReviewPolicy(enabled=False)) == (False, "LLM_ENABLED=false")
    assert gate(spark, "B", policy=ReviewPolicy(has_key=False))[1] == "provedor openai sem API key configurada"
    loose = ReviewPolicy(skip_tier_a=False)
    assert gate(spark, "A", 0.5, policy=loose) == (True, "probabilidade 0.5000 < LLM_MIN_PROBA=0.7")
    assert gate(spark, "A", 0.9, 0.1, loose) == (True, "gap top1–top2 0.1000 < LLM_MIN_TOP_GAP=0.15")
    assert gate(spark, "A", policy=loose)[0] is False
    assert gate(spark, "A", None, None, loose) == (False, review.NOT_MET)


def test_context_and_prompt(spark, scored, entries):
    df = scored.withColumn("SIT_LACRE", F.lit(" APROVADO ")).withColumn("OBSAFER", F.lit("it's " * 80)).withColumn("INDRST_GER", F.lit(" "))
    table = spark.createDataFrame([("1", 0.5, 0.25, 0.3, 9, "B")], "class string, precision double, recall double, f1 double, support int, tier string")
    got = {r.numero_laudo: r for r in review.review_context(df, entries, table).collect()}
    top = got[2].topk_proba
    assert [t["class"] for t in top] == ["1", "10"] and got[2].top1_top2_gap == pytest.approx(0.1)
    snap = {s.key: s.value for s in got[1].feature_snapshot}
    assert list(snap) == ["SIT_LACRE", "OBSAFER"] and snap["SIT_LACRE"] == "APROVADO"
    assert len(snap["OBSAFER"]) == 280 and snap["OBSAFER"].endswith("...")
    assert got[4].top1_top2_gap is None and got[1].class_metrics is None
    assert got[3].glossary_text.split("\n")[0] == "CODRSTAFER 99: (ausente no glossário) — não inventar significado operacional."
    context = review.review_context(df, entries, table)
    prompts = {r.numero_laudo: r.prompt for r in review.review_prompts(context, "numero_laudo").collect()}
    assert set(prompts) == {2, 3}
    assert "Métricas de validação da classe prevista: F1=0.3000, precision=0.5000, recall=0.2500, support=9, tier_treino=B." in prompts[2]
    assert "SIT_LACRE='APROVADO', OBSAFER=\"it's" in prompts[2]
    assert "Gap top1–top2: 0.1000." in prompts[2] and "indisponível" in prompts[3]
    assert review.review_context(df, entries).filter("class_metrics IS NOT NULL").count() == 0


def test_merge_changes_nothing_else(spark, scored):
    texts = spark.createDataFrame([(2, "text"), (2, "text"), (9, "other")], "numero_laudo int, review_text string")
    out = review.merge_reviews(scored, texts, "numero_laudo")
    assert {r.numero_laudo: r.revisao_llm for r in out.collect()} == {1: None, 2: "text", 3: None, 4: None}
    assert out.drop("revisao_llm").exceptAll(scored.select(out.drop("revisao_llm").columns)).count() == 0


def test_glossary_rules(spark):
    rows = [
        (1, 10, " text ", " a "), (2, 10, "later", "R"), (3, 11, "11", "R"), (4, 12, " ", "x"), (5, None, "lost", "A"), (6, 13, None, None),
    ]
    source = spark.createDataFrame(rows, "n int, CODRSTAFER int, DSCRSTAFER string, SITRSTAFER string")
    tiers = spark.createDataFrame([("10", "A")], "class string, tier string")
    built = glossary.build_glossary(source, "n", tiers)
    got = {r.code: tuple(r)[1:] for r in built.collect()}
    assert got == {
        "10": ("text", "text", "A", "Aprovado", "confirmado", "A"),
        "11": (None, None, "R", "Reprovado", "pendente", None),
        "12": (None, None, None, None, "pendente", None),
        "13": (None, None, None, None, "pendente", None),
    }
    assert tuple(glossary.glossary_counts(built).first()) == (4, 1, 3, 1, 1)
    with pytest.raises(ValueError, match="SITRSTAFER"):
        glossary.build_glossary(source.drop("SITRSTAFER"), "n")
    assert glossary.load_glossary(spark, "/no/such/place")[1] == "empty"


def test_history(spark, scored, tmp_path):
    path = str(tmp_path / "history")
    rows = scored.select(F.col("numero_laudo").cast("string").alias("numero_laudo"), "classe_prevista")
    history.append_history(rows, path, "ana")
    history.append_history(rows, path, "rui")
    stored = history.read_history(spark, path)
    assert stored.count() == 8 and stored.select("id").distinct().count() == 8
    found = history.query_history(stored, "2").collect()
    assert len(found) == 2 and found[0].criado_em >= found[1].criado_em
    assert history.query_history(stored, "unknown").count() == 0
    assert history.query_history(stored, "2", limit=1).count() == 1
    old = stored.withColumn("criado_em", F.col("criado_em") - F.expr("INTERVAL 10 DAYS")).withColumn("criado_dia", F.to_date("criado_em"))
    both = stored.unionByName(old)
    since = datetime.now() - timedelta(days=1)
    assert history.query_history(both, "2", start=since).count() == 2
    assert history.query_history(both, "2", end=since).count() == 2
    plan = history.query_history(stored, "2", start=since)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(criado_dia" in plan and "EqualTo(numero_laudo,2)" in plan


def test_padded_codes_are_one_entry(spark):
    source = spark.createDataFrame([(2, " 5", "late", "A"), (1, "5", "first", "R"), (3, "6 ", None, None)],
                                   "n int, CODRSTAFER string, DESRSTAFER string, SITRSTAFER string")
    built = glossary.build_glossary(source, "n", columns=("CODRSTAFER", "DESRSTAFER", "SITRSTAFER"))
    assert sorted((r.code, r.label) for r in built.collect()) == [("5", "first"), ("6", None)]


def test_broken_glossary_is_empty(spark, tmp_path):
    (tmp_path / "part-0.parquet").write_bytes(b"PAR1 this is no table PAR1")
    stored, status = glossary.load_glossary(spark, str(tmp_path))
    assert status == "empty" and stored.count() == 0


def test_tiers_of_a_stored_registry(spark, reports, tmp_path):
    write_registry(registry_document(reports, "code"), f"{tmp_path}/registry")
    tiers = glossary.load_tiers(spark, f"{tmp_path}/registry")
    assert {r["class"]: r["tier"] for r in tiers.collect()}["101"] == "A"
    source = spark.createDataFrame([(1, "101", "text", "A"), (2, "zz", "other", "R")], "n int, code string, text string, mark string")
    rows = glossary.build_glossary(source, "n", tiers, ("code", "text", "mark")).collect()
    assert {r["code"]: r["tier"] for r in rows} == {"101": "A", "zz": None}
    assert glossary.load_tiers(spark, f"{tmp_path}/none").count() == 0
    for name, text in (("broken", '{"classes": [{"class": "1", '), ("other", '{"classes": 5}'), ("odd", '{"classes": [{"class": "1"}, {"tier": "B"}, {"class": 7, "tier": "C"}]}')):
        (tmp_path / name).write_text(text)
        assert [tuple(r) for r in glossary.load_tiers(spark, f"{tmp_path}/{name}").collect()] == ([("7", "C")] if name == "odd" else [])
