"""Queries on reading, cleaning, profiling and exploring tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from calibra.config import DEFAULT_PROFILE
from calibra.functions.text import slugify
from calibra.operators import clean, explore, profile
from calibra.operators.features import feature_groups
from calibra.plans.registry import Source, load, query, tag
from calibra.session import scratch_path
from calibra.sources.tables import LINE, load_table, read_csv_batch

# White space class for the oracle, whose \s knows ASCII only.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip_sql(col: str) -> str:
    return f"regexp_replace(regexp_replace({col}, '^{SPACE}+', ''), '{SPACE}+$', '')"


DIRTY = Source(
    "customer",
    (
        "c_custkey",
        "CASE WHEN c_custkey % 3 = 0 THEN concat(chr(9), chr(160), c_name, ' ', chr(10)) ELSE c_name END AS c_name",
        "c_nationkey",
        "c_acctbal",
        "CASE WHEN c_custkey % 7 = 0 THEN '   ' WHEN c_custkey % 11 = 0 THEN concat(' ', c_mktsegment) "
        "ELSE c_mktsegment END AS c_mktsegment",
    ),
    doubled=True,
)
DIRTY_COLUMNS = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
CLEAN_SQL = (
    f"SELECT DISTINCT c_custkey, NULLIF({strip_sql('c_name')}, '') AS c_name, c_nationkey, c_acctbal, "
    f"NULLIF({strip_sql('c_mktsegment')}, '') AS c_mktsegment FROM {DIRTY.sql} t"
)

ORDERS = Source(
    "orders",
    (
        "o_orderkey",
        "o_custkey",
        "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice",
        "o_orderdate",
        "CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE NULL END AS rare_note",
        "o_orderpriority",
        "CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0 END AS even_flag",
        "concat('a long remark on the order of customer ', o_custkey) AS remark",
        "o_orderstatus",
    ),
)
ORDERS_TYPES = {
    "o_orderkey": "bigint",
    "o_custkey": "bigint",
    "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz",
    "rare_note": "string",
    "o_orderpriority": "string",
    "even_flag": "int",
    "remark": "string",
    "o_orderstatus": "string",
}
ORDERS_POLICY = replace(DEFAULT_PROFILE, deny_list=("not_there", "o_custkey", "o_orderstatus"))
ORDERS_TARGET = "o_orderstatus"


@query("io_load", "SELECT * FROM customer")
def io_load(spark, sf_dir):
    return load_table(spark, f"{sf_dir}/customer.parquet")


CSV = Source(
    "orders",
    (
        "CAST(o_orderkey AS VARCHAR(20)) AS o_orderkey",
        "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus",
        "CAST(o_totalprice AS VARCHAR(30)) AS o_totalprice",
        "concat(o_orderpriority, ', \"quoted\"') AS o_orderpriority",
    ),
)


@query(
    "csv_intake",
    f"SELECT row_number() OVER (ORDER BY CAST(o_orderkey AS BIGINT)) AS {LINE}, * FROM {CSV.sql} t",
)
def csv_intake(spark, sf_dir):
    path = scratch_path(spark, "csv")
    text = load(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_orderkey").cast("string").alias("k"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.col("o_totalprice").cast("string").alias("o_totalprice"),
        F.concat("o_orderpriority", F.lit(', "quoted"')).alias("o_orderpriority"),
    )
    (
        text.repartitionByRange(4, "o_orderkey")
        .sortWithinPartitions("o_orderkey")
        .select(F.col("k").alias("o_orderkey"), "o_orderstatus", "o_totalprice", "o_orderpriority")
        .write.option("header", True).option("escape", '"').csv(path)
    )
    return read_csv_batch(spark, path)


@query(
    "normalize_strings",
    f"SELECT c_custkey, NULLIF({strip_sql('c_name')}, '') AS c_name, c_nationkey, c_acctbal, "
    f"NULLIF({strip_sql('c_mktsegment')}, '') AS c_mktsegment FROM {DIRTY.sql} t",
)
def normalize_strings(spark, sf_dir):
    return clean.normalize_strings(DIRTY.load(spark, sf_dir))


@query("dedup_rows", CLEAN_SQL)
def dedup_rows(spark, sf_dir):
    return clean.dedup_rows(clean.normalize_strings(DIRTY.load(spark, sf_dir)))


@query("drop_null_target", f"SELECT * FROM ({CLEAN_SQL}) c WHERE c_mktsegment IS NOT NULL")
def drop_null_target(spark, sf_dir):
    return clean.clean(DIRTY.load(spark, sf_dir), "c_mktsegment")


@query(
    "cleaning_counts",
    f"""WITH raw AS (SELECT COUNT(*) AS n FROM {DIRTY.sql} t),
    c AS (SELECT COUNT(*) AS d, COUNT(c_mktsegment) AS k FROM ({CLEAN_SQL}) q)
    SELECT n AS original_rows, d AS deduplicated_rows, k AS cleaned_rows, n - d AS duplicate_rows_removed,
    d - k AS target_null_rows_removed FROM raw, c""",
)
def cleaning_counts(spark, sf_dir):
    return clean.cleaning_counts(DIRTY.load(spark, sf_dir), "c_mktsegment")


@query("project_denylist", "SELECT * EXCLUDE (l_tax, l_suppkey) FROM lineitem")
def project_denylist(spark, sf_dir):
    return clean.project_denylist(load(spark, sf_dir, "lineitem"), ("l_tax", "not_there", "l_suppkey", "l_partkey"), "l_partkey")


CONSTANTS = Source(
    "lineitem",
    (
        "l_quantity",
        "l_linenumber",
        "7 AS always_seven",
        "CASE WHEN l_quantity < 0 THEN l_quantity END AS all_null",
        "CASE WHEN l_linenumber > 1 THEN 1 END AS one_or_null",
        "l_returnflag",
    ),
)
_CONSTANT_NAMES = ("l_quantity", "l_linenumber", "always_seven", "all_null", "one_or_null", "l_returnflag")


@query(
    "constant_columns",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", COUNT(DISTINCT {c}) + MAX(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) <= 1 "
        f"AS is_constant FROM {CONSTANTS.sql} t"
        for c in _CONSTANT_NAMES
    ),
)
def constant_columns(spark, sf_dir):
    return clean.constant_columns(CONSTANTS.load(spark, sf_dir))


CORR = Source(
    "lineitem",
    (
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_extendedprice * 2 AS price_twice",
        "l_tax",
        "-l_discount AS rebate",
        "1.5e0 AS flat",
        "CASE WHEN l_linenumber > 2 THEN l_quantity + l_tax END AS part_quantity",
    ),
)
_CORR_NAMES = ("l_quantity", "l_extendedprice", "l_discount", "price_twice", "l_tax", "rebate", "flat", "part_quantity")


def _corr_sql() -> str:
    rows = []
    for i, a in enumerate(_CORR_NAMES):
        for j in range(i + 1, len(_CORR_NAMES)):
            b = _CORR_NAMES[j]
            rows.append(f"SELECT {i + 1} AS i, {j + 1} AS j, '{a}' AS column_i, '{b}' AS column_j, corr({a}, {b}) AS r FROM t")
    return f"WITH t AS {CORR.sql}, c AS ({' UNION ALL '.join(rows)}) "


@query(
    "correlation_matrix",
    _corr_sql() + "SELECT i, j, column_i, column_j, CASE WHEN isnan(r) THEN NULL ELSE round(r, 6) + 0.0 END AS corr FROM c",
)
def correlation_matrix(spark, sf_dir):
    out = explore.correlation_matrix(CORR.load(spark, sf_dir))
    return out.withColumn("corr", F.round("corr", 6) + F.lit(0.0))


@query(
    "corr_three",
    """SELECT round(corr(l_quantity, l_extendedprice), 6) AS ab, round(corr(l_quantity, l_tax), 6) AS ac,
    round(corr(l_extendedprice, l_tax), 6) AS bc FROM lineitem""",
)
def corr_three(spark, sf_dir):
    """Three columns go the same way as any number."""
    out = explore.correlation_matrix(load(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])
    pair = lambda i, j: F.round(F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("corr"))), 6)
    return out.agg(pair(1, 2).alias("ab"), pair(1, 3).alias("ac"), pair(2, 3).alias("bc"))


@query(
    "corr_prune",
    _corr_sql() + 'SELECT DISTINCT column_j AS "column" FROM c WHERE NOT isnan(r) AND abs(r) > 0.95',
)
def corr_prune(spark, sf_dir):
    return explore.correlated_columns(CORR.load(spark, sf_dir), 0.95)


@query(
    "slugify",
    r"""SELECT page_id, CASE WHEN s = '' THEN 'target' ELSE s END AS slug FROM (
    SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '[^\p{L}\p{N}]', '_', 'g'), '^_+|_+$', '', 'g') AS s
    FROM pages) t""",
)
def slug(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", slugify(F.col("url")).alias("slug"))


def _profile_sql() -> str:
    rows = [
        f"SELECT '{c}' AS \"column\", '{t}' AS type, {i} AS position, COUNT(*) AS n_rows, "
        f"COUNT(*) - COUNT({c}) AS null_count, round((COUNT(*) - COUNT({c}))::DOUBLE / COUNT(*) * 100, 2) AS null_pct "
        f"FROM {ORDERS.sql} t"
        for i, (c, t) in enumerate(ORDERS_TYPES.items(), 1)
    ]
    return " UNION ALL ".join(rows)


@query("profile_columns", _profile_sql())
def profile_columns(spark, sf_dir):
    return profile.profile_columns(ORDERS.load(spark, sf_dir))


@query("high_null", f"SELECT * FROM ({_profile_sql()}) p WHERE null_pct > 50.0")
def high_null(spark, sf_dir):
    return profile.high_null_columns(ORDERS.load(spark, sf_dir))


@query("datetime_cols", f"SELECT * FROM ({_profile_sql()}) p WHERE type = 'timestamp_ntz'")
def datetime_cols(spark, sf_dir):
    return profile.datetime_profile(ORDERS.load(spark, sf_dir))


_TEXTS = ("text", "lang", "source")


@query(
    "free_text",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(AVG(length({strip_sql(c)})), 4) AS avg_len, "
        f"round(COUNT(DISTINCT {strip_sql(c)})::DOUBLE / COUNT(*), 4) AS card_ratio FROM documents"
        for c in _TEXTS
    )
    + ") t WHERE avg_len > 30 OR card_ratio > 0.8",
)
def free_text(spark, sf_dir):
    return profile.free_text_columns(load(spark, sf_dir, "documents"))


_CUSTOMER = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query(
    "id_like",
    'SELECT "column" FROM ('
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", COUNT(DISTINCT {c}) + MAX(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS d, COUNT(*) AS n FROM customer"
        for c in _CUSTOMER
    )
    + ") t WHERE d = n",
)
def id_like(spark, sf_dir):
    df = load(spark, sf_dir, "customer")
    return profile.flag_rows(df, profile.build_profile(df).id_like)


BINARY = Source(
    "labels",
    ("doc_id", "quality", "toxic", "quality + toxic AS both_marks", "CASE WHEN doc_id < 0 THEN 1 END AS nothing"),
)


@query(
    "binary_cols",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", COALESCE(bool_and({c} IN (0, 1)), TRUE) AS is_binary FROM {BINARY.sql} t"
        for c in ("doc_id", "quality", "toxic", "both_marks", "nothing")
    ),
)
def binary_cols(spark, sf_dir):
    return profile.binary_columns(BINARY.load(spark, sf_dir))


def _facts_sql() -> str:
    """Per column of ORDERS: the facts all recommendation rules need."""
    rows = []
    for i, (c, t) in enumerate(ORDERS_TYPES.items(), 1):
        text = t == "string"
        numeric = t in ("bigint", "double", "int")
        length = f"AVG(length({strip_sql(c)}))" if text else "NULL"
        words = f"COUNT(DISTINCT {strip_sql(c)})" if text else "NULL"
        binary = f"COALESCE(bool_and({c} IN (0, 1)), TRUE)" if numeric else "FALSE"
        rows.append(
            f"SELECT '{c}' AS c, {i} AS pos, '{t}' AS t, {text} AS is_text, {numeric} AS is_number, COUNT(*) AS n, "
            f"COUNT(*) - COUNT({c}) AS nulls, round((COUNT(*) - COUNT({c}))::DOUBLE / COUNT(*) * 100, 2) AS pct, "
            f"COUNT(DISTINCT {c}) + MAX(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS d, "
            f"{length}::DOUBLE AS len, {words}::DOUBLE AS words, {binary} AS is_binary FROM {ORDERS.sql} t"
        )
    return f"""WITH f AS ({' UNION ALL '.join(rows)}),
    r AS (SELECT *, is_text AND nulls < n AND (len > 30 OR words / n > 0.8) AS is_free FROM f),
    q AS (SELECT *, CASE WHEN pct > 50.0 THEN 1 WHEN d = n THEN 2 WHEN t = 'timestamp_ntz' THEN 3 WHEN is_free THEN 4
        WHEN c = 'o_custkey' THEN 5 END AS why FROM r WHERE c <> '{ORDERS_TARGET}'),
    a AS (SELECT *, CASE WHEN why IS NOT NULL THEN 'drop' WHEN is_number AND NOT is_binary THEN 'scale'
        WHEN is_text THEN 'encode' END AS action,
        CASE why WHEN 1 THEN 'high_null' WHEN 2 THEN 'id_like' WHEN 3 THEN 'datetime' WHEN 4 THEN 'free_text'
        WHEN 5 THEN 'deny_list' ELSE CASE WHEN is_number THEN 'numeric' ELSE 'string' END END AS reason FROM q),
    w AS (SELECT action, CAST(row_number() OVER (PARTITION BY action ORDER BY COALESCE(why, 0), pos) AS INT) AS position,
        c AS "column", reason FROM a WHERE action IS NOT NULL) """


@query("recommend", _facts_sql() + "SELECT * FROM w")
def recommend(spark, sf_dir):
    df = ORDERS.load(spark, sf_dir)
    return profile.recommendation_rows(df, profile.recommend(df, ORDERS_TARGET, ORDERS_POLICY))


@query(
    "profile_report",
    _facts_sql()
    + """SELECT 'shape' AS section, 'table' AS item, 'rows' AS metric, CAST(MAX(n) AS VARCHAR) AS value FROM f
    UNION ALL SELECT 'shape', 'table', 'columns', CAST(COUNT(*) AS VARCHAR) FROM f
    UNION ALL SELECT 'types', c, 'type', t FROM f
    UNION ALL SELECT 'nulls', c, 'null_count', CAST(nulls AS VARCHAR) FROM f WHERE nulls > 0
    UNION ALL SELECT 'nulls', c, 'null_pct', printf('%.2f', pct) FROM f WHERE nulls > 0
    UNION ALL SELECT 'free_text', c, 'avg_len', printf('%.1f', len) FROM r WHERE is_free
    UNION ALL SELECT 'free_text', c, 'card_ratio', printf('%.2f', words / n) FROM r WHERE is_free
    UNION ALL SELECT 'drop', "column", 'reason', reason FROM w WHERE action = 'drop'
    UNION ALL SELECT action, "column", 'position', CAST(position AS VARCHAR) FROM w WHERE action <> 'drop'""",
)
def profile_report(spark, sf_dir):
    return profile.profile_report(ORDERS.load(spark, sf_dir), ORDERS_TARGET, ORDERS_POLICY)


@query(
    "feature_groups",
    _facts_sql()
    + """SELECT c AS "column", CASE WHEN action = 'scale' THEN 'scaled' WHEN is_text THEN 'categorical'
    ELSE 'passthrough' END AS feature_group FROM a WHERE is_number OR is_text""",
)
def groups(spark, sf_dir):
    df = ORDERS.load(spark, sf_dir)
    g = feature_groups(df, profile.recommend(df, ORDERS_TARGET, ORDERS_POLICY), (ORDERS_TARGET,))
    rows = [(c, "scaled") for c in g.scaled]
    rows += [(c, "categorical") for c in g.categorical]
    rows += [(c, "passthrough") for c in g.passthrough]
    return spark.createDataFrame(rows, "column string, feature_group string")


@query(
    "field_specs",
    f"""SELECT "column" AS name, CASE type WHEN 'bigint' THEN 'int' WHEN 'int' THEN 'int' WHEN 'double' THEN 'float'
    ELSE 'str' END AS type_name, null_pct > 0 AS nullable, null_pct FROM ({_profile_sql()}) p
    WHERE "column" NOT IN ('{ORDERS_TARGET}', 'o_custkey')""",
)
def field_specs(spark, sf_dir):
    return profile.field_specs(ORDERS.load(spark, sf_dir), ORDERS_TARGET, ("o_custkey",))


_NULL_SUM = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in ORDERS_TYPES)


@query(
    "densest_row",
    f"SELECT *, {_NULL_SUM} AS null_fields FROM {ORDERS.sql} t ORDER BY null_fields, o_orderkey LIMIT 1",
)
def densest_row(spark, sf_dir):
    return profile.densest_row(ORDERS.load(spark, sf_dir), "o_orderkey")


HIST = Source(
    "lineitem",
    tuple(f"{e} AS v{i}" for i, e in enumerate(
        ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey", "l_suppkey", "l_orderkey",
         "5 + 0 * l_linenumber", "l_extendedprice * (1 - l_discount)", "CASE WHEN l_linenumber > 3 THEN l_quantity END")
    )),
)


def _bin(x: str, low: str, high: str) -> str:
    return (
        f"CAST(CASE WHEN ({high} - {low}) / 30 > 0 THEN LEAST(FLOOR(({x} - {low}) / NULLIF(({high} - {low}) / 30, 0)), 29) "
        "ELSE 0 END AS INT)"
    )


def _hist_sql() -> str:
    rows = [
        f"SELECT 'v{i}' AS \"column\", {i // 9 + 1} AS page, {_bin(f'v{i}::DOUBLE', 'lo', 'hi')} AS bin "
        f"FROM t, (SELECT MIN(v{i})::DOUBLE AS lo, MAX(v{i})::DOUBLE AS hi FROM t) m WHERE v{i} IS NOT NULL"
        for i in range(11)
    ]
    return (
        f"WITH t AS {HIST.sql}, b AS ({' UNION ALL '.join(rows)}), "
        'h AS (SELECT "column", page, bin, COUNT(*) AS count FROM b GROUP BY ALL) '
    )


@query("histograms", _hist_sql() + "SELECT * FROM h")
def histograms(spark, sf_dir):
    return explore.histograms(HIST.load(spark, sf_dir))


@query(
    "feature_pages",
    _hist_sql()
    + 'SELECT page, "column", COUNT(*) AS bins, CAST(SUM(count) AS BIGINT) AS shown FROM h GROUP BY page, "column"',
)
def feature_pages(spark, sf_dir):
    return explore.histograms(HIST.load(spark, sf_dir)).groupBy("page", "column").agg(
        F.count(F.lit(1)).alias("bins"), F.sum("count").alias("shown")
    )


@query(
    "scatter_bins",
    "WITH m AS (SELECT MIN(l_quantity) AS q0, MAX(l_quantity) AS q1, MIN(l_discount) AS d0, MAX(l_discount) AS d1, "
    "MIN(l_extendedprice) AS p0, MAX(l_extendedprice) AS p1 FROM lineitem), "
    f"b AS (SELECT 'l_quantity' AS \"column\", {_bin('l_quantity', 'q0', 'q1')} AS x_bin, {_bin('l_extendedprice', 'p0', 'p1')} AS y_bin "
    f"FROM lineitem, m UNION ALL SELECT 'l_discount', {_bin('l_discount', 'd0', 'd1')}, {_bin('l_extendedprice', 'p0', 'p1')} FROM lineitem, m) "
    'SELECT "column", x_bin, y_bin, COUNT(*) AS count FROM b GROUP BY ALL',
)
def scatter_bins(spark, sf_dir):
    return explore.scatter_bins(load(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")


def _box_sql() -> str:
    one = (
        "SELECT l_returnflag, '{c}' AS \"column\", {c} AS v FROM lineitem"
    )
    rows = " UNION ALL ".join(one.format(c=c) for c in ("l_extendedprice", "l_quantity"))
    return f"""WITH l AS ({rows}),
    q AS (SELECT l_returnflag AS f, "column" AS c, COUNT(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
        quantile_cont(v, 0.75) AS q3 FROM l GROUP BY ALL)
    SELECT l_returnflag, "column", n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, MIN(v) AS min, MAX(v) AS max,
    MIN(v) FILTER (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)) AS whisker_low,
    MAX(v) FILTER (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
    COUNT(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers
    FROM l JOIN q ON l.l_returnflag = q.f AND l."column" = q.c GROUP BY l_returnflag, "column", n, q1, median, q3"""


@query("box_by_class", _box_sql())
def box_by_class(spark, sf_dir):
    out = explore.box_by_class(load(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity"], "l_returnflag")
    return out.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


def _roles_sql() -> str:
    numeric = [c for c, t in ORDERS_TYPES.items() if t in ("bigint", "double", "int") and c != "o_custkey"]
    rows = []
    for c in ORDERS_TYPES:
        if c == ORDERS_TARGET:
            continue
        role = "denied" if c == "o_custkey" else "numeric" if c in numeric else "not_numeric"
        page = str(numeric.index(c) // 9 + 1) if role == "numeric" else "NULL"
        rows.append(
            f"SELECT '{c}' AS \"column\", {tag(role)} AS role, CAST({page} AS INT) AS page, COUNT({c}) AS non_null FROM {ORDERS.sql} t"
        )
    return " UNION ALL ".join(rows)


@query("exploration_metadata", _roles_sql())
def exploration_metadata(spark, sf_dir):
    return explore.exploration_metadata(ORDERS.load(spark, sf_dir), ORDERS_TARGET, ORDERS_POLICY.deny_list)
