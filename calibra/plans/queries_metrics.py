"""Queries on metrics, model selection and training."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from calibra.config import TrainPolicy
from calibra.operators import classes, metrics, selection, split
from calibra.operators.training import build_registry, fit_classifier, load_classifier, save_classifier
from calibra.plans.queries_classes import DIST, EVENTS
from calibra.plans.registry import Source, load, query
from calibra.plans.train import compile_models, run_training
from calibra.session import materialize, scratch_path
from calibra.sources.artifacts import model_catalog

_TRUTH = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"
_SCORE = (
    "CAST((l_linenumber * {a} + CAST(l_quantity AS INT) * {b} + CAST(l_discount * 100 AS INT)) % 37 AS DOUBLE) / 40 "
    "+ CASE WHEN {t} = {c} THEN 0.05e0 ELSE 0.0e0 END"
)
_SCORES = [_SCORE.format(a=3 + 2 * c, b=7 + c, t=_TRUTH, c=c) for c in range(3)]

# Deterministic pseudo-predictions: truth, prediction and one score per class.
SCORED = Source(
    "lineitem",
    (
        f"{_TRUTH} AS truth",
        "(l_linenumber + CAST(l_quantity AS INT)) % 3 AS pred",
        "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_r",
        "l_linenumber % 2 AS guess",
        *[f"{s} AS s{c}" for c, s in enumerate(_SCORES)],
        "l_returnflag",
        "l_linestatus",
    ),
)


def _with_scores(spark, sf_dir):
    return SCORED.load(spark, sf_dir).withColumn("scores", F.array("s0", "s1", "s2"))


def _class_sql(truth: str, pred: str, classes: str, source: str = "t") -> str:
    """Per-class figures over the given class list."""
    return f"""g AS (SELECT c.class, COUNT(*) FILTER ({truth} = c.class) AS support, COUNT(*) FILTER ({pred} = c.class) AS predicted,
        COUNT(*) FILTER ({truth} = c.class AND {pred} = c.class) AS hits FROM {source}, ({classes}) c GROUP BY c.class),
    pr AS (SELECT *, COALESCE(hits::DOUBLE / NULLIF(predicted, 0), 0) AS p, COALESCE(hits::DOUBLE / NULLIF(support, 0), 0) AS r FROM g),
    m AS (SELECT *, COALESCE(2 * p * r / NULLIF(p + r, 0), 0) AS f FROM pr) """


_THREE = "SELECT 0 AS class UNION ALL SELECT 1 UNION ALL SELECT 2"
_FOUR = _THREE + " UNION ALL SELECT 3"


def _rounded(df, names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


_FIGURES = ("accuracy", "precision", "recall", "f1")


@query(
    "macro_metrics",
    f"WITH t AS {SCORED.sql}, {_class_sql('truth', 'pred', _THREE)}"
    "SELECT round(SUM(hits)::DOUBLE / SUM(support), 6) AS accuracy, round(AVG(p), 6) AS precision, round(AVG(r), 6) AS recall, "
    "round(AVG(f), 6) AS f1, 'macro' AS average, TRUE AS multiclass FROM m",
)
def macro_metrics(spark, sf_dir):
    return _rounded(metrics.classification_metrics(SCORED.load(spark, sf_dir), "truth", "pred"), _FIGURES)


@query(
    "binary_metrics",
    f"WITH t AS {SCORED.sql}, {_class_sql('is_r', 'guess', 'SELECT 0 AS class UNION ALL SELECT 1')}"
    "SELECT (SELECT round(SUM(hits)::DOUBLE / SUM(support), 6) FROM m) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, "
    "round(f, 6) AS f1, 'binary' AS average, FALSE AS multiclass FROM m WHERE class = 1",
)
def binary_metrics(spark, sf_dir):
    return _rounded(metrics.classification_metrics(SCORED.load(spark, sf_dir), "is_r", "guess"), _FIGURES)


def _rank_sql(cases: list[tuple[int, str, str]]) -> str:
    """Per class: ROC-AUC and average precision over distinct scores."""
    rows = " UNION ALL ".join(f"SELECT {i} AS class, {score} AS s, ({hit})::INT AS hit FROM t" for i, score, hit in cases)
    return f"""WITH t AS {SCORED.sql}, l AS ({rows}),
    d AS (SELECT class, s, SUM(hit) AS pos, COUNT(*) - SUM(hit) AS neg FROM l GROUP BY ALL),
    w AS (SELECT *, SUM(neg) OVER (PARTITION BY class ORDER BY s) - neg AS n_below,
        SUM(pos) OVER (PARTITION BY class ORDER BY s DESC) AS p_from,
        SUM(pos + neg) OVER (PARTITION BY class ORDER BY s DESC) AS all_from,
        SUM(pos) OVER (PARTITION BY class) AS pa, SUM(neg) OVER (PARTITION BY class) AS na FROM d),
    a AS (SELECT class, MAX(pa) AS pa, MAX(na) AS na, SUM(pos * (n_below + neg / 2.0))::DOUBLE / (MAX(pa) * MAX(na)) AS roc,
        SUM(pos * p_from::DOUBLE / all_from) / MAX(pa) AS pr FROM w GROUP BY class) """


_OVR = _rank_sql([(c, f"s{c}", f"truth = {c}") for c in range(3)])


@query("roc_auc_ovr", _OVR + "SELECT round(AVG(roc), 6) AS roc_auc FROM a")
def roc_auc_ovr(spark, sf_dir):
    out = metrics.auc_summary(_with_scores(spark, sf_dir), "truth", "scores", [0, 1, 2])
    return out.select(F.round("roc_auc", 6).alias("roc_auc"))


@query("pr_auc_ovr", _OVR + "SELECT round(AVG(pr), 6) AS pr_auc FROM a")
def pr_auc_ovr(spark, sf_dir):
    out = metrics.auc_summary(_with_scores(spark, sf_dir), "truth", "scores", [0, 1, 2])
    return out.select(F.round("pr_auc", 6).alias("pr_auc"))


@query(
    "class_auc",
    _OVR
    + "SELECT class, CAST(pa AS BIGINT) AS positives, CAST(na AS BIGINT) AS negatives, round(roc, 6) AS roc_auc, round(pr, 6) AS pr_auc FROM a",
)
def class_auc(spark, sf_dir):
    out = metrics.ranking_metrics(_with_scores(spark, sf_dir), "truth", "scores", [0, 1, 2])
    return _rounded(out, ("roc_auc", "pr_auc"))


@query(
    "roc_auc_binary",
    _rank_sql([(1, "s2", "is_r = 1")]) + "SELECT round(roc, 6) AS roc_auc, round(pr, 6) AS pr_auc FROM a",
)
def roc_auc_binary(spark, sf_dir):
    df = SCORED.load(spark, sf_dir).withColumn("scores", F.array(1 - F.col("s2"), F.col("s2")))
    return _rounded(metrics.auc_summary(df, "is_r", "scores", [0, 1]), ("roc_auc", "pr_auc"))


@query(
    "per_class_metrics",
    f"WITH t AS {SCORED.sql}, {_class_sql('truth', 'pred', _FOUR)}"
    "SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM m",
)
def per_class_metrics(spark, sf_dir):
    out = metrics.per_class_metrics(SCORED.load(spark, sf_dir), "truth", "pred", [0, 1, 2, 3])
    return _rounded(out, ("precision", "recall", "f1"))


@query(
    "per_class_tiers",
    DIST
    + f""", t AS (SELECT dense_rank() OVER (ORDER BY k) - 1 AS truth, user_id % 27 AS pred, k FROM e
        WHERE CAST(k AS VARCHAR) IN (SELECT class FROM kept)),
    labels AS (SELECT DISTINCT truth AS class, CAST(k AS VARCHAR) AS original_class FROM t),
    {_class_sql('truth', 'pred', 'SELECT class FROM labels')}
    SELECT m.class, original_class, tier, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support
    FROM m JOIN labels USING (class) LEFT JOIN kept ON kept.class = original_class""",
)
def per_class_tiers(spark, sf_dir):
    df = EVENTS.load(spark, sf_dir)
    kept = classes.purge_rows(df, "k")
    sizes = split.class_sizes(kept, "k")
    index = split.label_index(sizes[0], "k")
    labels = index.select(F.col("label").alias("class"), F.col("k").cast("string").alias("original_class"))
    scored = split.with_label(kept, "k", sizes).withColumn("pred", F.col("user_id") % 27)
    ids = [r["class"] for r in labels.collect()]  # at most 100 / min share classes
    table = metrics.per_class_metrics(scored, "label", "pred", ids)
    out = metrics.with_labels_and_tiers(table, labels, classes.class_registry(df, "k"))
    return _rounded(out, ("precision", "recall", "f1"))


@query(
    "confusion_matrix",
    f"""WITH t AS {SCORED.sql}, c AS ({_FOUR}) SELECT a.class AS truth, b.class AS prediction, COUNT(t.truth) AS count
    FROM c a CROSS JOIN c b LEFT JOIN t ON t.truth = a.class AND t.pred = b.class GROUP BY ALL""",
)
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(SCORED.load(spark, sf_dir), "truth", "pred", [0, 1, 2, 3])


_GAPPED = f"(SELECT truth, CASE WHEN pred = 2 THEN 4 ELSE pred END AS pred FROM {SCORED.sql} x)"


@query(
    "lite_metrics",
    f"WITH t AS {_GAPPED}, {_class_sql('truth', 'pred', 'SELECT CAST(range AS INT) AS class FROM range(5)')}"
    "SELECT round(SUM(hits)::DOUBLE / SUM(support), 6) AS accuracy, round(AVG(p), 6) AS precision, round(AVG(r), 6) AS recall, "
    "round(AVG(f), 6) AS f1, 'macro' AS average, TRUE AS multiclass FROM m",
)
def lite_metrics(spark, sf_dir):
    df = SCORED.load(spark, sf_dir).withColumn("pred", F.when(F.col("pred") == 2, 4).otherwise(F.col("pred")))
    return _rounded(metrics.lite_metrics(df, "truth", "pred"), _FIGURES)


# --- folds, champion, gate -------------------------------------------------------

FOLDED = Source(
    "orders",
    (
        "o_orderkey",
        "CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS truth",
        "CASE WHEN o_custkey % 4 = 0 THEN CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END "
        "ELSE CAST(o_custkey % 3 AS INT) END AS pred",
    ),
)


def _group_metrics_sql(group: str, source: str) -> str:
    """Macro figures per group, over the classes seen in it."""
    return f"""cl AS (SELECT DISTINCT {group} AS g, truth AS class FROM {source} UNION SELECT DISTINCT {group}, pred FROM {source}),
    gm AS (SELECT g, class, COUNT(*) FILTER (truth = class) AS support, COUNT(*) FILTER (pred = class) AS predicted,
        COUNT(*) FILTER (truth = class AND pred = class) AS hits FROM {source} JOIN cl ON {group} = g GROUP BY g, class),
    gp AS (SELECT *, COALESCE(hits::DOUBLE / NULLIF(predicted, 0), 0) AS p, COALESCE(hits::DOUBLE / NULLIF(support, 0), 0) AS r FROM gm),
    gf AS (SELECT g, AVG(p) AS precision_macro, AVG(r) AS recall_macro, AVG(COALESCE(2 * p * r / NULLIF(p + r, 0), 0)) AS f1_macro
        FROM gp GROUP BY g) """


@query(
    "cv_summary",
    f"""WITH f AS {FOLDED.sql}, t AS (SELECT *, ntile(5) OVER (PARTITION BY truth
        ORDER BY md5(concat_ws(':', '42', CAST(o_orderkey AS VARCHAR)))) - 1 AS fold FROM f),
    {_group_metrics_sql('fold', 't')}
    SELECT 'f1_macro' AS metric, round(AVG(f1_macro), 6) AS mean, round(stddev_pop(f1_macro), 6) AS std, COUNT(*) AS folds FROM gf
    UNION ALL SELECT 'recall_macro', round(AVG(recall_macro), 6), round(stddev_pop(recall_macro), 6), COUNT(*) FROM gf""",
)
def cv_summary(spark, sf_dir):
    folded = split.kfold(FOLDED.load(spark, sf_dir), "truth", ["o_orderkey"], 5)
    per_fold = metrics.fold_metrics(folded, "truth", "pred", "fold")
    return _rounded(metrics.summarize_folds(per_fold, ["f1_macro", "recall_macro"]), ("mean", "std"))


RUNS = Source(
    SCORED.table,
    (*SCORED.columns[:2], "concat(l_returnflag, '-', CAST(l_linenumber AS VARCHAR(5)), '-', l_linestatus) AS run"),
)


def _runs(spark, sf_dir):
    table = metrics.fold_metrics(RUNS.load(spark, sf_dir), "truth", "pred", "run")
    return table.select(
        "run",
        F.when(F.col("run").endswith("O"), F.lit("none")).otherwise(F.lit("smote")).alias("resampling"),
        F.round("f1_macro", 9).alias("f1"),
        F.round("recall_macro", 9).alias("recall"),
        F.when(~F.col("run").startswith("N"), F.round("precision_macro", 9)).alias("roc_auc"),
    )


_RUNS_SQL = f"""WITH t AS {RUNS.sql}, {_group_metrics_sql('run', 't')},
    runs AS (SELECT g AS run, CASE WHEN g LIKE '%O' THEN 'none' ELSE 'smote' END AS resampling, round(f1_macro, 9) AS f1,
        round(recall_macro, 9) AS recall, CASE WHEN g LIKE 'N%' THEN NULL ELSE round(precision_macro, 9) END AS roc_auc FROM gf) """


@query("champion", _RUNS_SQL + "SELECT run, resampling, round(f1, 6) AS f1 FROM runs ORDER BY COALESCE(runs.f1, 0) DESC, run LIMIT 1")
def champion(spark, sf_dir):
    best = selection.champion(_runs(spark, sf_dir), "run")
    return best.select("run", "resampling", F.round("f1", 6).alias("f1"))


@query(
    "phase_gate",
    _RUNS_SQL
    + """, g2 AS (SELECT COALESCE(MIN(recall), 0) AS a, COALESCE(MIN(f1), 0) AS b, COALESCE(MIN(roc_auc), 0) AS c
        FROM runs WHERE resampling = 'none')
    SELECT round(a, 6) AS recall_min, round(b, 6) AS f1_min, round(c, 6) AS roc_auc_min,
    a < 0.7 OR b < 0.7 OR c < 0.7 AS run_next_phase FROM g2""",
)
def phase_gate(spark, sf_dir):
    return _rounded(selection.phase_gate(_runs(spark, sf_dir)), ("recall_min", "f1_min", "roc_auc_min"))


# --- training ----------------------------------------------------------------------

# Boosting runs one Spark job per tree level and round, about half a second a round whatever the size of a small
# table, so the registry's 500 and 600 rounds take minutes; README has the figures. All else is as the registry says.
# The training run below (`workflow_smoke`, `model_catalog`) has the registry's rounds.
ROUNDS = 4
QUICK = {"gbt": {"maxIter": ROUNDS}, "gbt_balanced": {"maxIter": ROUNDS}}


def _train_frame(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings").select(
        "vec_id",
        (F.col("label") % 3).alias("target"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
    )
    return rows


def _train(spark, sf_dir, algorithm):
    """Metrics of one algorithm on the hash-ordered test fifth."""
    # written once, as in a training run: every pass of the fit reads it
    frame = materialize(split.prepare_split(_train_frame(spark, sf_dir), TrainPolicy(target="target"), ["vec_id"]), "split")
    spec = build_registry(42, 3, QUICK)[algorithm]
    model = selection.train_on(spec, frame.filter(~F.col("is_test")), None, "vec_id", algorithm != "knn")
    scored = model.transform(frame.filter("is_test"), "vec_id")
    return metrics.classification_metrics(scored, "label", "prediction", average="macro").withColumn(
        "algorithm", F.lit(algorithm)
    )


def _register_training() -> None:
    for algorithm in ("gbt", "gbt_balanced", "rf", "logreg", "knn"):
        def build(spark, sf_dir, algorithm=algorithm):
            return _train(spark, sf_dir, algorithm)

        query(f"train_{algorithm}")(build)


_register_training()


@query("param_sample")
def param_sample(spark, sf_dir):
    frame = _train_frame(spark, sf_dir).select("vec_id", (F.col("target") == 0).cast("int").alias("label"), "features")
    spec = build_registry(42, 2, QUICK)["gbt"]
    policy = TrainPolicy("target")
    space = selection.SEARCH_SPACES["gbt"] | {"maxIter": [2, 3, ROUNDS]}
    _, found = selection.search_parameters(spec, frame, "vec_id", policy.search_iterations, policy.search_folds, space=space)
    rows = [(i, str(sorted(combo.items())), score, score == found.best_score) for i, (combo, score) in enumerate(found.trials)]
    return spark.createDataFrame(rows, "trial int, params string, score double, best boolean")


def _whole_run(spark, sf_dir):
    """Three algorithms with the registry's settings, and one it does not have."""
    policy = TrainPolicy("target", algorithms=("gbt", "logreg", "not_there", "rf"), resampling=(None, "smote"))
    return run_training(_train_frame(spark, sf_dir), policy, "vec_id")


@query("workflow_smoke")
def workflow_smoke(spark, sf_dir):
    return _whole_run(spark, sf_dir).summary


@query("model_catalog")
def catalog(spark, sf_dir):
    result = _whole_run(spark, sf_dir)
    root = scratch_path(spark, "compiled")
    compile_models(result, spark, root)
    return model_catalog(spark, root).select("stem", "role", "algorithm", "resampling", "feature_columns_count")


@query("model_roundtrip", "SELECT COUNT(*) AS rows, COUNT(*) AS same FROM embeddings")
def model_roundtrip(spark, sf_dir):
    frame = split.with_label(_train_frame(spark, sf_dir), "target")
    spec = build_registry(42, 3, QUICK)["gbt"]
    model = fit_classifier(spec, frame)
    path = scratch_path(spark, "model")
    save_classifier(model, spark, path)
    before = model.transform(frame).select("vec_id", F.col("prediction").alias("before"))
    after = load_classifier(spark, path).transform(frame).select("vec_id", F.col("prediction").alias("after"))
    both = before.join(after, "vec_id")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("before") == F.col("after"), 1)).alias("same"))
