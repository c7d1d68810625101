"""Whole runs: prepare, train, compile, score, stream."""

from __future__ import annotations

import threading

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibra.config import TierPolicy, TrainPolicy
from calibra.operators import selection
from calibra.operators.training import DEFAULT_PARAMS, ClassifierSpec, build_registry, for_rounds
from calibra.plans import prepare as prep
from calibra.plans import queries_metrics, scoring, train
from calibra.plans.catalog import all_queries
from calibra.session import keep_checkpoints, scratch_root
from calibra.sources.artifacts import load_features, model_catalog, read_json
from calibra.streaming.scoring import read_record_stream, stream_to_history

TIERS = TierPolicy(min_percentage=15.0)
QUICK = (("gbt", (("maxIter", 3), ("maxDepth", 3), ("stepSize", 0.3))), ("logreg", (("maxIter", 10),)))


@pytest.fixture(scope="module")
def root(spark, reports, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("run"))
    done = prep.run_preparation(reports, "code", path, ("id",), tiers=TIERS)
    policy = TrainPolicy("code", ("gbt", "missing", "logreg"), (None, "smote"), min_percentage=15.0, overrides=QUICK)
    result = train.run_training(spark.read.parquet(f"{path}/vectors"), policy, "id", path, TIERS, done.features.names)
    return path, done, result


def test_preparation(spark, reports, root):
    path, done, _ = root
    assert done.selection.kept == ["n1", "n2", "n3", "cat"]
    assert done.features.method == "svd" and done.features.names[0] == "svd_001"
    meta = read_json(spark, f"{path}/metadata")
    assert meta["class_purge"]["retained_class_count"] == 3 and len(meta["class_purge"]["removed_classes"]) == 10
    wide = spark.read.parquet(f"{path}/prepared")
    assert wide.columns[0] == "code" and wide.count() == meta["class_purge"]["retained_rows"]
    stages = spark.read.option("header", True).csv(f"{path}/distribution/csv")
    assert {r.stage for r in stages.select("stage").distinct().collect()} == {"before_purge", "after_purge"}
    again = load_features(f"{path}/features").transform(done.training).select("id", F.col("features").alias("again"))
    joined = done.dataset.join(again, "id")
    assert joined.count() == done.dataset.count() and joined.filter("features = again").count() == joined.count()
    champion = read_json(spark, f"{path}/compiled/champion/metadata")
    assert champion["class_weight_registry_path"] == f"{path}/registry"
    assert ("classes", "13 -> 3") in prep.summary_rows(done)


def test_exploration_data(spark, root):
    path = f"{root[0]}/exploration"
    bins = spark.read.parquet(f"{path}/histograms").groupBy("column").agg(F.sum("count").alias("n")).collect()
    total = root[1].cleaned.count()
    assert {r.column: r.n for r in bins} == {"n1": total, "n2": total, "n3": total}
    assert spark.read.parquet(f"{path}/correlations").count() == 3
    assert set(spark.read.parquet(f"{path}/by_target").columns) == {"column", "x_bin", "y_bin", "count"}
    roles = {r.column: r.role for r in spark.read.json(f"{path}/metadata").collect()}
    assert roles == {"n1": "numeric", "n2": "numeric", "n3": "numeric", "cat": "not_numeric"}


def test_exploration_of_a_text_target(spark, reports, tmp_path):
    frame = reports.select("n1", "n2", F.col("code").cast("string").alias("code"))
    prep.write_exploration(frame, "code", str(tmp_path / "x"))
    boxes = spark.read.parquet(str(tmp_path / "x/by_target"))
    assert boxes.count() == 26 and "median" in boxes.columns


def test_purge_can_be_disabled(reports):
    from calibra.config import PreparePolicy

    done = prep.prepare(reports, "code", ("id",), PreparePolicy(enable_purge=False), TIERS, transform=False)
    assert done.training.count() == reports.count()


def test_training_grid(root):
    _, _, result = root
    assert [(r.algorithm, r.resampling) for r in result.results] == [
        ("gbt", None), ("gbt", "smote"), ("logreg", None), ("logreg", "smote"),
    ]
    for r in result.results:
        assert all(0 <= r.metrics[k] <= 1 for k in ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc"))
        assert [c["original_class"] for c in r.per_class] == ["101", "102", "103"]
    assert result.classes == ["101", "102", "103"] and result.summary.count() == 4
    assert len(train.console_rows(result)) >= 4


def test_compiled_models(spark, root):
    path, _, result = root
    rows = model_catalog(spark, f"{path}/compiled").collect()
    assert [r.role for r in rows] == ["champion"] + ["variant"] * 4
    assert [r.stem for r in rows[1:]] == ["gbt_none", "gbt_smote", "logreg_none", "logreg_smote"]
    best = max(result.results, key=lambda r: r.metrics["f1"])
    assert (rows[0].algorithm, rows[0].resampling) == (best.algorithm, best.resampling or "none")
    meta = read_json(spark, f"{path}/compiled/champion/metadata")
    assert meta["champion_of"]["algorithm"] == best.algorithm and meta["target_classes"] == result.classes


def test_catalog_without_models(spark, tmp_path):
    assert "run a training job" in model_catalog(spark, str(tmp_path / "none")).first().message


def test_results_without_model_are_skipped(spark, tmp_path):
    run = train.RunResult("gbt", None, {"f1": 0.5}, [])
    result = train.TrainResult([run], train.summary_frame(spark, [run]), ["a"], {})
    train.compile_models(result, spark, str(tmp_path / "c"))
    assert result.compiled == [] and result.champion is None


def scorer_of(spark, root):
    return scoring.load_scorer(spark, root[0], ("n1", "n2", "n3", "cat"), "id", policy=TIERS)


def test_scoring_paths_agree(spark, reports, root, tmp_path):
    scorer = scorer_of(spark, root)
    full = reports.drop("code").withColumn("other", F.lit("unused"))
    lean = reports.select("id", *scorer.columns)
    a = scoring.score_single(scorer, full, "id", str(tmp_path / "h"), "ana")
    b = scoring.score_single(scorer, lean, "id")
    assert a.count() == 600 and a.exceptAll(b).count() == 0
    assert spark.read.parquet(str(tmp_path / "h")).count() == 600
    lean.repartitionByRange(3, "id").sortWithinPartitions("id").write.option("header", True).csv(str(tmp_path / "csv"))
    contract = T.StructType([T.StructField(f.name, f.dataType, False) for f in lean.schema])
    lines = scoring.score_csv(scorer, str(tmp_path / "csv"), contract)
    assert lines.count() == 600 and lines.filter("numero_linha - 1 <> int(numero_laudo) OR revisao_llm IS NOT NULL").count() == 0
    same = lines.select("numero_laudo", "classe_prevista").exceptAll(a.select("numero_laudo", "classe_prevista"))
    assert same.count() == 0


def test_reviews_only_where_asked(spark, reports, root):
    scorer = scorer_of(spark, root)
    texts = reports.select("id", F.lit("text").alias("review_text"))
    out = scoring.score_single(scorer, reports.drop("code"), "id", reviews=texts)
    assert out.filter("camada = 'A' AND revisao_llm IS NOT NULL").count() == 0
    forced = scoring.score_single(scorer, reports.drop("code"), "id", reviews=texts, force=True)
    assert forced.filter("revisao_llm = 'text'").count() == 600


def test_scorer_errors(spark, reports, root, tmp_path):
    with pytest.raises(ValueError, match="champion.*registry"):
        scoring.load_scorer(spark, str(tmp_path), (), "id")
    with pytest.raises(ValueError, match="n1, n2"):
        scorer_of(spark, root).score(reports.drop("n1", "n2"))


def test_stream_to_history(spark, reports, root, tmp_path):
    records = reports.drop("code")
    source = str(tmp_path / "in")
    records.repartition(3).write.parquet(source)
    stream = read_record_stream(spark, source, records.schema, "*.parquet")
    for _ in range(2):  # a second run finds nothing new
        q = stream_to_history(stream, scorer_of(spark, root), str(tmp_path / "out"), str(tmp_path / "ck"), "ana")
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 600


def test_cross_validation_in_a_run(spark, root):
    policy = TrainPolicy("code", ("logreg",), ("smote",), min_percentage=15.0, cross_validate=True, cv_folds=2, overrides=QUICK)
    result = train.run_training(spark.read.parquet(f"{root[0]}/vectors"), policy, "id")
    folds = result.results[0].cross_validation
    assert folds["cv_folds_used"] == 2 and len(folds["recall_macro"]["folds"]) == 2


def test_presets():
    assert train.compile_policy("t").resampling == ("smote",) and train.compile_policy("t").algorithms == ("gbt",)
    assert train.compile_policy("t", include_balanced=True).algorithms == ("gbt_balanced", "gbt")
    assert train.compile_policy("t", ["rf", "gbt", "rf"], resampling=["none", "Nenhum", "adasyn"]).algorithms == ("rf", "gbt")
    assert train.compile_policy("t", resampling=["none", "ADASYN"]).resampling == (None, "adasyn")
    assert train.first_phase("t").search and train.second_phase("t").cross_validate
    assert len(train.six_combinations("t").resampling) * len(train.six_combinations("t").algorithms) == 6
    assert TrainPolicy("t").algorithms == ("gbt",) and TrainPolicy("t").resampling == ("smote",)


def test_scratch_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert scratch_root(spark) == (named or scratch_root(spark))


class FakeSession:
    """A session without the folder setting."""

    def __init__(self, master):
        self.conf = self
        self.sparkContext = self
        self.master = master
        self.applicationId = "app-1"

    def get(self, key, default=None):
        return default


def test_scratch_folder_without_setting():
    local = FakeSession("local[2]")
    assert scratch_root(local) == scratch_root(local)
    with pytest.raises(RuntimeError, match="shared folder"):
        scratch_root(FakeSession("yarn"))


def test_fit_on_training_rows_only(reports):
    from calibra.config import PreparePolicy
    from calibra.operators.split import prepare_split

    done = prep.prepare(reports, "code", ("id",), PreparePolicy(fit_scope="train", enable_reduction=False), TIERS)
    rows = prepare_split(done.training, TrainPolicy("code", min_percentage=15.0), ["id"]).filter("NOT is_test")
    params = prep.feature_groups and rows.agg(F.avg("n1"), F.stddev_pop("n1")).first()
    row = done.dataset.join(reports, "id").select("n1", "features").first()
    assert row.features[0] == pytest.approx((row.n1 - params[0]) / params[1])
    with pytest.raises(ValueError, match="key"):
        prep.prepare(reports.drop("id"), "code", (), PreparePolicy(fit_scope="train"), TIERS)


def test_class_metrics_of_a_report(spark, root, tmp_path):
    from calibra.sources.artifacts import load_class_metrics

    table = {r["class"]: r for r in load_class_metrics(spark, f"{root[0]}/report/details").collect()}
    first = {c["original_class"]: c for c in root[2].results[0].per_class}
    assert {c: r.f1 for c, r in table.items()} == {c: e["f1"] for c, e in first.items()}
    assert load_class_metrics(spark, str(tmp_path / "none")).count() == 0


def test_two_phases(spark, root):
    vectors = spark.read.parquet(f"{root[0]}/vectors")
    base = {"min_percentage": 15.0, "overrides": QUICK}
    one = TrainPolicy("code", ("logreg",), (None,), **base)
    out = train.run_two_phases(vectors, "id", one, TrainPolicy("code", ("logreg",), ("smote",), **base))
    assert (out["second"] is not None) == out["gate"]["run_next_phase"]


def test_rows_of_a_strategy_are_made_once(spark, monkeypatch):
    """Two algorithms share the synthetic rows, and get what each would have made for itself."""
    rows = [(i, "a" if i % 4 else "b", Vectors.dense([float(i % 7), float(i % 4), i / 10])) for i in range(80)]
    df = spark.createDataFrame(rows, ["id", "code", "features"])
    calls, inner = [], selection.resample
    monkeypatch.setattr(selection, "resample", lambda *args, **more: calls.append(args[1]) or inner(*args, **more))
    policy = TrainPolicy("code", ("logreg", "rf"), (None, "smote"), overrides=(("logreg", (("maxIter", 5),)), ("rf", (("numTrees", 3),))))
    both = train.run_training(df, policy, "id").summary.drop("seq").collect()
    assert calls == ["smote"]
    alone = TrainPolicy("code", ("rf",), ("smote",), overrides=policy.overrides)
    assert both[3] == train.run_training(df, alone, "id").summary.drop("seq").first()


def test_training_queries_run_the_settings_of_the_registry(spark, monkeypatch):
    """Both queries of a whole run ask for the registry's rounds, trees and iterations; small fits answer here."""
    rows = [(i, i % 3, Vectors.dense([float(i % 7), float(i % 3), i / 10])) for i in range(90)]
    df = spark.createDataFrame(rows, ["vec_id", "target", "features"])
    small = {"gbt": {"maxIter": 1, "maxDepth": 1}, "rf": {"numTrees": 1}, "logreg": {"maxIter": 1}}
    asked, inner = [], train.train_on

    def fit(spec, *args):
        asked.append((spec.name, spec.params))
        return inner(ClassifierSpec(spec.name, {**spec.params, **small[spec.name]}, spec.n_classes, spec.seed), *args)

    monkeypatch.setattr(queries_metrics, "_train_frame", lambda *_: df)
    monkeypatch.setattr(train, "train_on", fit)
    for name in ("workflow_smoke", "model_catalog"):
        asked.clear()
        assert all_queries()[name](spark, "").count() > 0
        assert asked == [(a, DEFAULT_PARAMS[a]) for a in ("gbt", "logreg", "rf") for _ in range(2)]


def test_strategies_run_at_the_same_time_in_order(spark, monkeypatch):
    """The fits of one algorithm wait for each other, which only ends if they are under way together."""
    rows = [(i, "a" if i % 4 else "b", Vectors.dense([float(i % 7), float(i % 4), i / 10])) for i in range(80)]
    df = spark.createDataFrame(rows, ["id", "code", "features"])
    meet, inner = threading.Barrier(2, timeout=60), train.train_on
    monkeypatch.setattr(train, "train_on", lambda *args: meet.wait() is not None and inner(*args))
    policy = TrainPolicy("code", ("logreg", "rf"), ("smote", None), overrides=(("rf", (("numTrees", 3),)), *QUICK))
    out = train.run_training(df, policy, "id")
    assert [(r.algorithm, r.resampling) for r in out.results] == [(a, s) for a in ("logreg", "rf") for s in ("smote", None)]


def test_rounds_read_few_tasks(spark, monkeypatch):
    rows = [(i, i % 2, Vectors.dense([float(i), 1.0])) for i in range(100)]
    df = spark.createDataFrame(rows, ["id", "label", "features"]).repartition(8)
    registry = build_registry()
    assert for_rounds(registry["rf"], df).rdd.getNumPartitions() == 8
    few = for_rounds(registry["gbt"], df)
    assert few.rdd.getNumPartitions() == 1 and few.orderBy("id").collect() == df.orderBy("id").collect()
    monkeypatch.setattr("calibra.operators.training.ROUND_VALUES", 70)  # 200 numbers
    assert for_rounds(registry["gbt_balanced"], df).rdd.getNumPartitions() == 3
    assert for_rounds(registry["gbt"], df.limit(0)).count() == 0


def test_checkpoints_have_a_folder():
    class Context(FakeSession):
        kept = None

        def getCheckpointDir(self):  # noqa: N802
            return self.kept

        def setCheckpointDir(self, path):  # noqa: N802
            self.kept = path

    session = Context("local[2]")
    keep_checkpoints(session)
    assert session.kept.startswith(f"{scratch_root(session)}/checkpoints-")
    session.kept = "there"
    keep_checkpoints(session)
    assert session.kept == "there"
