"""Queries on class distribution, feature preparation, splits and resampling."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from calibra.config import PreparePolicy, TierPolicy, TrainPolicy
from calibra.operators import classes, features, neighbors, resample, split
from calibra.operators.wide import vector_entries
from calibra.plans.prepare import lite_prepare, prepare, prepare_counts
from calibra.plans.queries_tables import CLEAN_SQL, DIRTY
from calibra.plans.registry import Source, load, query
from calibra.session import scratch_path
from calibra.sources.artifacts import write_prepared

EVENTS = Source("events", ("event_id", "user_id", "event_type", "value", "CAST(FLOOR(value / 10) AS INT) AS k"))
CLASS_BOUND = classes.retained_bound(0.1)


def _tier(pct: str = "percentage") -> str:
    return f"CASE WHEN {pct} >= 15.0 THEN 'A' WHEN {pct} >= 1.0 THEN 'B' WHEN {pct} >= 0.1 THEN 'C' ELSE 'D' END"


DIST = f"""WITH e AS {EVENTS.sql},
    d AS (SELECT CAST(k AS VARCHAR) AS class, COUNT(*) AS count FROM e GROUP BY 1),
    p AS (SELECT *, round(count::DOUBLE / SUM(count) OVER () * 100, 4) AS percentage FROM d),
    q AS (SELECT *, {_tier()} AS tier FROM p),
    kept AS (SELECT *, round((SUM(count) OVER ())::DOUBLE / ((COUNT(*) OVER ()) * count), 6) AS weight
        FROM q WHERE percentage >= 0.1) """

SUMMARY = """s AS (SELECT CAST(SUM(count) AS BIGINT) AS total_rows,
        CAST(COALESCE(SUM(CASE WHEN percentage >= 0.1 THEN count END), 0) AS BIGINT) AS retained_rows,
        COUNT(CASE WHEN percentage >= 0.1 THEN 1 END) AS retained_class_count,
        COUNT(CASE WHEN percentage < 0.1 THEN 1 END) AS discarded_class_count FROM q) """


@query("class_distribution", DIST + "SELECT class, count, percentage FROM p")
def class_distribution(spark, sf_dir):
    return classes.class_distribution(EVENTS.load(spark, sf_dir), "k")


@query("class_tiers", DIST + "SELECT * FROM q")
def class_tiers(spark, sf_dir):
    return classes.class_tiers(EVENTS.load(spark, sf_dir), "k")


@query(
    "class_weights",
    DIST + "SELECT class, count, percentage, round((SUM(count) OVER ())::DOUBLE / ((COUNT(*) OVER ()) * count), 6) AS weight FROM p",
)
def class_weights(spark, sf_dir):
    return classes.class_weights(EVENTS.load(spark, sf_dir), "k")


@query("rare_classes", DIST + "SELECT class, count, percentage FROM p WHERE percentage < 0.1")
def rare_classes(spark, sf_dir):
    return classes.rare_classes(EVENTS.load(spark, sf_dir), "k", 0.1)


@query("class_registry", DIST + "SELECT class, count, percentage, tier, weight FROM kept")
def class_registry(spark, sf_dir):
    return classes.class_registry(EVENTS.load(spark, sf_dir), "k")


@query(
    "class_registry_roles",
    f"""WITH d AS (SELECT role AS class, COUNT(*) AS count FROM conversations GROUP BY 1),
    p AS (SELECT *, round(count::DOUBLE / SUM(count) OVER () * 100, 4) AS percentage FROM d)
    SELECT class, count, percentage, {_tier()} AS tier,
    round((SUM(count) OVER ())::DOUBLE / ((COUNT(*) OVER ()) * count), 6) AS weight FROM p WHERE percentage >= 0.1""",
)
def class_registry_roles(spark, sf_dir):
    return classes.class_registry(load(spark, sf_dir, "conversations"), "role")


@query(
    "registry_discarded",
    DIST
    + "SELECT tier, COUNT(*) AS class_count, CAST(SUM(count) AS BIGINT) AS total_rows, round(SUM(percentage), 4) AS total_percentage "
    "FROM q WHERE percentage < 0.1 GROUP BY tier",
)
def registry_discarded(spark, sf_dir):
    return classes.registry_discarded(EVENTS.load(spark, sf_dir), "k")


@query(
    "registry_summary",
    DIST
    + ", "
    + SUMMARY
    + """SELECT 'k' AS target_column, 0.1::DOUBLE AS min_class_percentage, 'D' AS discard_tier_label, total_rows, retained_rows,
    round(retained_rows::DOUBLE / total_rows * 100, 4) AS retained_rows_percentage, retained_class_count, discarded_class_count,
    total_rows - retained_rows AS discarded_rows FROM s""",
)
def registry_summary(spark, sf_dir):
    return classes.registry_summary(EVENTS.load(spark, sf_dir), "k")


@query("registry_document")
def registry_document(spark, sf_dir):
    return classes.registry_document(EVENTS.load(spark, sf_dir), "k")


@query(
    "purge_rows",
    DIST + "SELECT e.* FROM e JOIN q ON CAST(e.k AS VARCHAR) = q.class WHERE percentage >= 0.1",
)
def purge_rows(spark, sf_dir):
    return classes.purge_rows(EVENTS.load(spark, sf_dir), "k")


@query(
    "purge_metadata",
    DIST
    + ", "
    + SUMMARY
    + """SELECT 0.1::DOUBLE AS min_class_percentage, total_rows AS original_rows, retained_rows,
    total_rows - retained_rows AS removed_rows, round(retained_rows::DOUBLE / total_rows * 100, 4) AS retained_rows_percentage,
    retained_class_count + discarded_class_count AS original_class_count, retained_class_count,
    discarded_class_count AS removed_class_count FROM s""",
)
def purge_metadata(spark, sf_dir):
    return classes.purge_metadata(EVENTS.load(spark, sf_dir), "k")


LOOSE = TierPolicy(min_percentage=0.01)


@query(
    "min_count_filter",
    DIST + "SELECT e.* FROM e JOIN q ON CAST(e.k AS VARCHAR) = q.class WHERE percentage >= 0.01 AND count >= 5",
)
def min_count_filter(spark, sf_dir):
    return classes.min_count_filter(EVENTS.load(spark, sf_dir), "k", LOOSE, 5)


@query(
    "dist_stages",
    DIST
    + f""", after AS (SELECT class, count, round(count::DOUBLE / SUM(count) OVER () * 100, 4) AS percentage FROM kept)
    SELECT class, count, percentage, tier, 'before_purge' AS stage FROM q
    UNION ALL SELECT class, count, percentage, {_tier()} AS tier, 'after_purge' AS stage FROM after""",
)
def dist_stages(spark, sf_dir):
    return classes.distribution_stages(EVENTS.load(spark, sf_dir), "k")


# --- features ------------------------------------------------------------------

PART = Source(
    "part",
    (
        "p_partkey",
        "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS p_size",
        "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_retailprice END AS p_retailprice",
        "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS p_brand",
        "p_type",
        "p_name",
        "3 AS flat",
    ),
)
PART_GROUPS = features.FeatureGroups(["p_size", "p_retailprice"], ["p_brand", "p_type"], ["flat"])
_NUMBERS = ("p_size", "p_retailprice", "flat")


def _filled_sql() -> str:
    cols = ", ".join(f"COALESCE({c}::DOUBLE, (SELECT quantile_cont({c}::DOUBLE, 0.5) FROM t)) AS {c}" for c in _NUMBERS)
    return f"WITH t AS {PART.sql}, f AS (SELECT p_partkey, {cols} FROM t) "


@query("impute_median", _filled_sql() + "SELECT * FROM f")
def impute_median(spark, sf_dir):
    return features.impute_median(PART.load(spark, sf_dir), list(_NUMBERS)).select("p_partkey", *_NUMBERS)


@query(
    "standardize",
    _filled_sql()
    + "SELECT p_partkey, "
    + ", ".join(
        f"round(({c} - (SELECT AVG({c}) FROM f)) / COALESCE(NULLIF((SELECT stddev_pop({c}) FROM f), 0), 1), 6) + 0.0 AS {c}"
        for c in _NUMBERS
    )
    + " FROM f",
)
def standardize(spark, sf_dir):
    out = features.standardize(PART.load(spark, sf_dir), list(_NUMBERS))
    return out.select("p_partkey", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in _NUMBERS])


@query(
    "impute_category",
    f"SELECT p_partkey, COALESCE(p_brand, '__missing__') AS p_brand, p_type FROM {PART.sql} t",
)
def impute_category(spark, sf_dir):
    return features.impute_category(PART.load(spark, sf_dir), ["p_brand", "p_type"]).select("p_partkey", "p_brand", "p_type")


_HOT = " UNION ALL ".join(
    f"SELECT p_partkey, '{c}' AS \"column\", COALESCE({c}, '__missing__') AS level, "
    f"dense_rank() OVER (ORDER BY COALESCE({c}, '__missing__')) - 1 AS level_index FROM {PART.sql} t"
    for c in ("p_brand", "p_type")
)


@query("one_hot", _HOT)
def one_hot(spark, sf_dir):
    return features.one_hot_long(PART.load(spark, sf_dir), "p_partkey", ["p_brand", "p_type"])


@query(
    "assemble",
    _filled_sql()
    + """, z AS (SELECT p_partkey, flat, (p_size - (SELECT AVG(p_size) FROM f)) / (SELECT stddev_pop(p_size) FROM f) AS a,
    (p_retailprice - (SELECT AVG(p_retailprice) FROM f)) / (SELECT stddev_pop(p_retailprice) FROM f) AS b FROM f)
    SELECT p_partkey, CAST(3 + (SELECT COUNT(DISTINCT COALESCE(p_brand, '__missing__')) + COUNT(DISTINCT p_type) FROM t) AS INT) AS width,
    (abs(a) > 1e-12)::INT + (abs(b) > 1e-12)::INT + 3 AS set_entries, round(a + b + 2 + flat, 6) + 0.0 AS total FROM z""",
)
def assemble(spark, sf_dir):
    df = PART.load(spark, sf_dir)
    fitted = features.fit_features(df, PART_GROUPS, PreparePolicy(enable_reduction=False))
    values = vector_to_array("features")
    return fitted.transform(df).select(
        "p_partkey",
        F.size(values).alias("width"),
        F.size(F.filter(values, lambda x: F.abs(x) > 1e-12)).alias("set_entries"),
        (F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), 6) + F.lit(0.0)).alias("total"),
    )


ITEMS = Source(
    "lineitem",
    (
        "l_orderkey * 10 + l_linenumber AS item",
        "concat('o', l_orderkey) AS order_level",
        "CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE l_returnflag END AS mode_level",
        "l_linenumber AS line",
        "CAST(l_quantity AS DOUBLE) AS quantity",
        "CASE WHEN l_orderkey % 10 < 6 THEN concat('q', CAST(floor(sqrt(CAST(l_quantity AS DOUBLE))) AS INT)) "
        "ELSE concat('o', l_orderkey) END AS skewed",
    ),
)


@query(
    "wide_vectors",
    f"""WITH t AS {ITEMS.sql}, n AS (SELECT COUNT(DISTINCT order_level) AS orders, COUNT(DISTINCT COALESCE(mode_level, '__missing__')) AS modes FROM t)
    SELECT item, 0 AS place, round((quantity - (SELECT AVG(quantity) FROM t)) / (SELECT stddev_pop(quantity) FROM t), 6) AS value FROM t
        WHERE quantity <> (SELECT AVG(quantity) FROM t)
    UNION ALL SELECT item, CAST(dense_rank() OVER (ORDER BY order_level) AS INT), 1.0::DOUBLE FROM t
    UNION ALL SELECT item, CAST(orders + dense_rank() OVER (ORDER BY COALESCE(mode_level, '__missing__')) AS INT), 1.0::DOUBLE FROM t, n
    UNION ALL SELECT item, CAST(1 + orders + modes AS INT), line::DOUBLE FROM t, n""",
)
def wide_vectors(spark, sf_dir):
    """Every entry of vectors with a level for each order."""
    groups = features.FeatureGroups(["quantity"], ["order_level", "mode_level"], ["line"])
    df = ITEMS.load(spark, sf_dir)
    fitted = features.fit_features(df, groups, PreparePolicy(enable_reduction=False))
    entries = fitted.transform(df).select("item", F.inline(vector_entries("features")))
    return entries.select("item", "place", (F.round("value", 6) + F.lit(0.0)).alias("value"))


@query(
    "svd_wide",
    f"""WITH t AS {ITEMS.sql}, c AS (SELECT skewed, COUNT(*)::DOUBLE AS c FROM t GROUP BY skewed),
    n AS (SELECT SUM(c) AS n, SUM(c * c) AS sq FROM c)
    SELECT 'svd_00' || place AS component, round(c * (n - c) / (n * n - sq), 6) AS explained
    FROM (SELECT c, row_number() OVER (ORDER BY c DESC) AS place FROM c), n WHERE place <= 6""",
)
def svd_wide(spark, sf_dir):
    """Shares of the leading components of one-hot levels: the singular values are the roots of their counts."""
    df = ITEMS.load(spark, sf_dir)
    fitted = features.fit_features(df, features.FeatureGroups([], ["skewed"], []), PreparePolicy(components=6))
    return spark.createDataFrame(
        [(n, round(r, 6)) for n, r in zip(fitted.names, fitted.explained, strict=True)], "component string, explained double"
    )


def _embeddings(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")
    )


@query("pca_variance")
def pca_variance(spark, sf_dir):
    rows = _embeddings(spark, sf_dir).select(array_to_vector("embedding").alias("__assembled"))
    _, ratios = features.fit_pca(rows, 0.95, 64)
    names = features.component_names("pca", len(ratios))
    return spark.createDataFrame([(n, round(r, 6)) for n, r in zip(names, ratios)], "component string, explained double")


@query("svd_variance")
def svd_variance(spark, sf_dir):
    fitted = features.fit_features(PART.load(spark, sf_dir), PART_GROUPS, PreparePolicy(components=8))
    return spark.createDataFrame(
        [(n, round(r, 6)) for n, r in zip(fitted.names, fitted.explained)], "component string, explained double"
    )


@query(
    "encode_target",
    "SELECT o_orderkey, o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS label FROM orders",
)
def encode_target(spark, sf_dir):
    df = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return split.encode_target(df, "o_orderpriority").select("o_orderkey", "o_orderpriority", "label")


RAW = Source(
    DIRTY.table,
    (*DIRTY.columns, "c_acctbal * 2 AS twice", "1 AS flat", "c_nationkey % 2 AS odd", "concat('grp', c_nationkey % 3) AS grp"),
    doubled=True,
)


def _prepare_sql() -> str:
    """Counters of the preparation, rule by rule."""
    clean = CLEAN_SQL
    return f"""WITH c AS ({clean}), k AS (SELECT *, c_acctbal * 2 AS twice, c_nationkey % 2 AS odd,
        concat('grp', c_nationkey % 3) AS grp FROM c WHERE c_mktsegment IS NOT NULL),
    n AS (SELECT COUNT(*) AS n FROM k),
    h AS (SELECT (COUNT(DISTINCT c_custkey) = COUNT(*))::INT AS key_drop,
        (COUNT(DISTINCT c_name) = COUNT(*) OR COUNT(DISTINCT c_name)::DOUBLE / COUNT(*) > 0.8)::INT AS name_drop,
        (COUNT(DISTINCT c_acctbal) = COUNT(*))::INT AS bal_drop FROM k),
    cls AS (SELECT COUNT(DISTINCT c_mktsegment) AS m FROM k),
    r AS (SELECT * FROM n, h, cls, (SELECT COUNT(*) AS raw FROM {RAW.sql} t) x, (SELECT COUNT(*) AS dd FROM c) y)
    SELECT 'original_rows' AS metric, raw AS value FROM r
    UNION ALL SELECT 'deduplicated_rows', dd FROM r
    UNION ALL SELECT 'cleaned_rows', n FROM r
    UNION ALL SELECT 'duplicate_rows_removed', raw - dd FROM r
    UNION ALL SELECT 'target_null_rows_removed', dd - n FROM r
    UNION ALL SELECT 'training_rows', n FROM r
    UNION ALL SELECT 'original_classes', m FROM r
    UNION ALL SELECT 'retained_classes', m FROM r
    UNION ALL SELECT 'dropped_heuristic', key_drop + name_drop + 2 * bal_drop FROM r
    UNION ALL SELECT 'dropped_constant', 1 FROM r
    UNION ALL SELECT 'dropped_correlated', 1 - bal_drop FROM r
    UNION ALL SELECT 'retained_features', 4 - bal_drop FROM r
    UNION ALL SELECT 'scaled_columns', 2 - bal_drop FROM r
    UNION ALL SELECT 'categorical_columns', 1 FROM r
    UNION ALL SELECT 'passthrough_columns', 1 FROM r"""


@query("prepare_metadata", _prepare_sql())
def prepare_metadata(spark, sf_dir):
    return prepare_counts(RAW.load(spark, sf_dir), "c_mktsegment")


@query("prepared_export")
def prepared_export(spark, sf_dir):
    done = prepare(RAW.load(spark, sf_dir), "c_mktsegment")
    path = scratch_path(spark, "export")
    wide = features.expand_features(done.dataset, done.features.names, "c_mktsegment")
    write_prepared(wide, "c_mktsegment", path, {"names": done.features.names})
    return spark.read.parquet(f"{path}/prepared")


@query(
    "lite_prepare",
    f"""WITH t AS {PART.sql} SELECT p_partkey::DOUBLE AS p_partkey,
    COALESCE(p_size::DOUBLE, (SELECT quantile_cont(p_size::DOUBLE, 0.5) FROM t)) AS p_size,
    COALESCE(p_retailprice::DOUBLE, (SELECT quantile_cont(p_retailprice::DOUBLE, 0.5) FROM t)) AS p_retailprice,
    dense_rank() OVER (ORDER BY COALESCE(p_brand, '__missing__')) - 1 AS p_brand,
    p_type, dense_rank() OVER (ORDER BY p_name) - 1 AS p_name FROM t""",
)
def lite(spark, sf_dir):
    return lite_prepare(PART.load(spark, sf_dir), "p_type", ("not_there",))


# --- split, folds, weights -------------------------------------------------------

POLICY = TrainPolicy(target="k")


@query(
    "split_metadata",
    DIST
    + """SELECT 0.1::DOUBLE AS min_class_percentage, 2 AS min_class_count,
    CAST(SUM(count) AS BIGINT) AS original_rows, COUNT(*) AS original_class_count,
    CAST(SUM(count) FILTER (percentage >= 0.1) AS BIGINT) AS rows_after_percentage_filter,
    COUNT(*) FILTER (percentage >= 0.1) AS class_count_after_percentage_filter,
    CAST(SUM(count) FILTER (percentage >= 0.1 AND count >= 2) AS BIGINT) AS training_rows,
    COUNT(*) FILTER (percentage >= 0.1 AND count >= 2) AS training_class_count,
    CAST(SUM(count) - SUM(count) FILTER (percentage >= 0.1 AND count >= 2) AS BIGINT) AS removed_rows,
    round((SUM(count) FILTER (percentage >= 0.1 AND count >= 2))::DOUBLE / SUM(count) * 100, 4) AS training_percentage FROM q""",
)
def split_metadata(spark, sf_dir):
    return split.split_metadata(EVENTS.load(spark, sf_dir), POLICY)


_RANKED = "r AS (SELECT event_id, k, row_number() OVER (PARTITION BY k ORDER BY md5(concat_ws(':', '42', CAST(event_id AS VARCHAR)))) AS rn FROM {src})"


@query(
    "stratified_split",
    DIST
    + f""", m AS (SELECT class, count, dense_rank() OVER (ORDER BY CAST(class AS INT)) - 1 AS label FROM kept WHERE count >= 2),
    w AS (SELECT *, CEIL(SUM(count) OVER () * 0.2::DOUBLE) AS want, SUM(count) OVER () AS total FROM m),
    x AS (SELECT *, count * want / total AS exact FROM w),
    y AS (SELECT *, FLOOR(exact) AS low, row_number() OVER (ORDER BY round(exact - FLOOR(exact), 9) DESC, CAST(class AS INT)) AS place FROM x),
    z AS (SELECT *, low + CASE WHEN place <= want - SUM(low) OVER () THEN 1 ELSE 0 END AS quota FROM y),
    {_RANKED.format(src="e")}
    SELECT r.event_id, r.k, z.label, r.rn <= z.quota AS is_test FROM r JOIN z ON CAST(r.k AS VARCHAR) = z.class""",
)
def stratified_split(spark, sf_dir):
    out = split.prepare_split(EVENTS.load(spark, sf_dir), POLICY, ["event_id"])
    return out.select("event_id", "k", "label", "is_test")


@query(
    "lite_split",
    f"""WITH e AS {EVENTS.sql}, c AS (SELECT k AS class, COUNT(*) AS n FROM e GROUP BY 1), {_RANKED.format(src="e")}
    SELECT event_id, k, rn <= GREATEST(1, round_even(n * 0.2::DOUBLE, 0)) AS is_test FROM r JOIN c ON k = class""",
)
def lite_split(spark, sf_dir):
    return split.lite_split(EVENTS.load(spark, sf_dir), "k", ["event_id"]).select("event_id", "k", "is_test")


@query(
    "kfold_assign",
    f"""WITH e AS {EVENTS.sql} SELECT event_id, k,
    ntile(5) OVER (PARTITION BY k ORDER BY md5(concat_ws(':', '42', CAST(event_id AS VARCHAR)))) - 1 AS fold FROM e""",
)
def kfold_assign(spark, sf_dir):
    return split.kfold(EVENTS.load(spark, sf_dir), "k", ["event_id"], 5).select("event_id", "k", "fold")


@query(
    "sample_weights",
    f"""WITH e AS {EVENTS.sql}, c AS (SELECT k AS class, COUNT(*) AS n FROM e GROUP BY 1)
    SELECT event_id, k, round((SELECT SUM(n) FROM c)::DOUBLE / ((SELECT COUNT(*) FROM c) * n), 6) AS weight
    FROM e JOIN c ON k = class""",
)
def sample_weights(spark, sf_dir):
    out = split.sample_weights(EVENTS.load(spark, sf_dir), "k")
    return out.select("event_id", "k", F.round("weight", 6).alias("weight"))


# --- resampling and neighbours ---------------------------------------------------


@query(
    "oversample_counts",
    f"""WITH e AS {EVENTS.sql}, c AS (SELECT k, COUNT(*) AS n FROM e GROUP BY 1)
    SELECT k, n AS originals, (SELECT MAX(n) FROM c) - n AS added, (SELECT MAX(n) FROM c) AS total FROM c""",
)
def oversample_counts(spark, sf_dir):
    out = resample.random_oversample(EVENTS.load(spark, sf_dir), "k", "event_id")
    return out.groupBy("k").agg(
        F.count(F.when(F.col("copy") == 0, 1)).alias("originals"),
        F.count(F.when(F.col("copy") > 0, 1)).alias("added"),
        F.count(F.lit(1)).alias("total"),
    )


@query(
    "smote_counts",
    "WITH c AS (SELECT label, COUNT(*) AS n FROM embeddings GROUP BY 1) SELECT label, (SELECT MAX(n) FROM c) AS total FROM c",
)
def smote_counts(spark, sf_dir):
    out = resample.resample(_embeddings(spark, sf_dir), "smote", "label", "vec_id", "embedding")
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("total"))


@query("smote_rows")
def smote_rows(spark, sf_dir):
    return resample.smote_rows(_embeddings(spark, sf_dir), "label", "vec_id", "embedding")


def _two_classes(spark, sf_dir):
    return _embeddings(spark, sf_dir).withColumn("target", (F.col("label") < 2).cast("int"))


_ALL_NEAR = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label, {target} AS target FROM embeddings),
    d AS (SELECT a.vec_id, a.target, b.target AS other, b.label, row_number() OVER (PARTITION BY a.vec_id
        ORDER BY list_distance(a.v, b.v), b.vec_id) AS rn FROM e a JOIN e b ON a.vec_id <> b.vec_id {where}) """


@query(
    "adasyn_ratio",
    _ALL_NEAR.format(target="(label < 2)::INT", where="WHERE a.target = 1")
    + """SELECT vec_id, target, CAST(SUM((other <> target)::INT) AS INT) AS other, SUM((other <> target)::INT) / 5.0::DOUBLE AS ratio
    FROM d WHERE rn <= 5 GROUP BY vec_id, target""",
)
def adasyn_ratio(spark, sf_dir):
    out = resample.adasyn_ratio(_two_classes(spark, sf_dir), "target", "vec_id", "embedding")
    return out.select("vec_id", "target", "other", "ratio")


@query("adasyn_rows")
def adasyn_rows(spark, sf_dir):
    return resample.adasyn_rows(_two_classes(spark, sf_dir), "target", "vec_id", "embedding")


@query(
    "knn_classify",
    _ALL_NEAR.format(target="label", where="")
    + """, v AS (SELECT vec_id, label, COUNT(*) AS c FROM d WHERE rn <= 7 GROUP BY 1, 2),
    w AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, label) AS place FROM v)
    SELECT vec_id, label AS prediction, CAST(c AS INT) AS votes FROM w WHERE place = 1""",
)
def knn_classify(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    out = neighbors.knn_classify(rows, rows, "vec_id", "embedding", "label", 7, exclude_self=True)
    return out.select("vec_id", "prediction", F.get("votes", F.lit(0)).getField("votes").alias("votes"))


@query(
    "class_neighbors",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
    d AS (SELECT a.vec_id, b.vec_id AS neighbor, list_distance(a.v, b.v) AS dist, row_number() OVER (PARTITION BY a.vec_id
        ORDER BY list_distance(a.v, b.v), b.vec_id) AS place FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id)
    SELECT vec_id, CAST(place AS INT) AS place, neighbor, round(dist, 6) AS distance FROM d WHERE place <= 5""",
)
def class_neighbors(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    near = neighbors.nearest(rows, rows, "vec_id", "embedding", 5, group="label")
    return near.select("vec_id", F.posexplode("neighbors").alias("at", "n")).select(
        "vec_id",
        (F.col("at") + 1).alias("place"),
        F.col("n.id").alias("neighbor"),
        F.round("n.distance", 6).alias("distance"),
    )


@query("neighbors_hashed", "SELECT COUNT(*) AS queries, 5 * COUNT(*) AS near, TRUE AS recall_reached, TRUE AS distances_right FROM embeddings")
def neighbors_hashed(spark, sf_dir):
    """The hash tables against the exact search: at least 0.9 of all true neighbours, and no wrong distance."""
    rows = _embeddings(spark, sf_dir)
    lists = []
    for share in (None, 0.95):
        near = neighbors.nearest(rows, rows, "vec_id", "embedding", 5, block=64, approximate=share)
        lists.append(near.select("vec_id", F.inline("neighbors")).select("vec_id", "id", "distance"))
    both = lists[1].join(lists[0].withColumnRenamed("distance", "true_distance"), ["vec_id", "id"], "left")
    right = F.col("true_distance").isNull() | (F.abs(F.col("distance") - F.col("true_distance")) < 1e-9)
    return both.agg(
        F.countDistinct("vec_id").alias("queries"),
        F.count(F.lit(1)).alias("near"),
        (F.count("true_distance") >= 0.9 * F.count(F.lit(1))).alias("recall_reached"),
        F.every(right).alias("distances_right"),
    )


_SHIFTED = "floor(1000 * x::DOUBLE) + 2000000000"


@query(
    "neighbors_offset",
    f"""WITH e AS (SELECT vec_id, [{_SHIFTED} FOR x IN embedding] AS v FROM embeddings),
    d AS (SELECT a.vec_id, b.vec_id AS neighbor, row_number() OVER (PARTITION BY a.vec_id
        ORDER BY list_sum([(x - b.v[i]) * (x - b.v[i]) FOR x, i IN a.v]), b.vec_id) AS place
        FROM e a JOIN e b ON a.vec_id <> b.vec_id)
    SELECT vec_id, CAST(place AS INT) AS place, neighbor FROM d WHERE place <= 5""",
)
def neighbors_offset(spark, sf_dir):
    """Whole-number vectors around 2e9, in several blocks and cells."""
    shifted = F.transform("embedding", lambda x: F.floor(1000 * x.cast("double")) + F.lit(2e9))
    rows = _embeddings(spark, sf_dir).withColumn("embedding", shifted)
    near = neighbors.nearest(rows, rows, "vec_id", "embedding", 5, block=256)
    return near.select("vec_id", F.posexplode("neighbors").alias("at", "n")).select(
        "vec_id", (F.col("at") + 1).alias("place"), F.col("n.id").alias("neighbor")
    )


@query(
    "sample_weights_null",
    f"""WITH e AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN k END AS k FROM {EVENTS.sql} t),
    c AS (SELECT k AS class, COUNT(*) AS n FROM e GROUP BY 1)
    SELECT event_id, k, round((SELECT SUM(n) FROM c)::DOUBLE / ((SELECT COUNT(*) FROM c) * n), 6) AS weight
    FROM e JOIN c ON k IS NOT DISTINCT FROM class""",
)
def sample_weights_null(spark, sf_dir):
    """A missing target is a class and keeps its rows."""
    rows = EVENTS.load(spark, sf_dir).withColumn("k", F.when(F.col("event_id") % 7 != 0, F.col("k")))
    return split.sample_weights(rows, "k").select("event_id", "k", F.round("weight", 6).alias("weight"))
