"""Column profile and the drop / scale / encode recommendations."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibra.config import DEFAULT_PROFILE, ProfilePolicy
from calibra.functions.text import strip
from calibra.functions.types import (
    datetime_columns,
    field_type_name,
    is_numeric,
    is_string,
    numeric_columns,
    string_columns,
    type_groups,
)
from calibra.operators.clean import denied_columns, nan_to_null

WIDE_TEXT = 32  # mean length above which distinct counts use digests
SLICES = 64  # parts of the value space of the first uniqueness check


def _null_pct(nulls: Column, total: Column) -> Column:
    return F.round(nulls / F.greatest(total, F.lit(1)) * 100, 2)


def profile_columns(df: DataFrame) -> DataFrame:
    """One row per column: type, position, rows, nulls, null share. One pass."""
    df = nan_to_null(df)
    aggs = [F.count(F.lit(1)).alias("n")] + [F.count(c).alias(f"c{i}") for i, c in enumerate(df.columns)]
    rows = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.lit(i + 1).alias("position"),
            F.col("n").alias("n_rows"),
            (F.col("n") - F.col(f"c{i}")).alias("null_count"),
            _null_pct(F.col("n") - F.col(f"c{i}"), F.col("n")).alias("null_pct"),
        )
        for i, f in enumerate(df.schema)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def high_null_columns(df: DataFrame, policy: ProfilePolicy = DEFAULT_PROFILE) -> DataFrame:
    return profile_columns(df).filter(F.col("null_pct") > policy.high_null_pct)


def datetime_profile(df: DataFrame) -> DataFrame:
    return profile_columns(df).filter(F.col("column").isin(datetime_columns(df) or [""]))


@dataclass(frozen=True)
class ColumnStats:
    name: str
    type: str
    nulls: int
    null_pct: float
    approx_distinct: int
    avg_len: float | None = None
    binary: bool = False


@dataclass(frozen=True)
class Profile:
    """Profile of a table; holds per-column facts only."""

    n_rows: int
    n_cols: int
    type_groups: dict[str, list[str]]
    stats: dict[str, ColumnStats]
    distinct: dict[str, int]
    high_null: list[str]
    free_text: list[str]
    id_like: list[str]
    datetime: list[str]

    def as_dict(self) -> dict[str, object]:
        return {
            "n_rows": self.n_rows,
            "n_cols": self.n_cols,
            "high_null_cols": self.high_null,
            "free_text_cols": self.free_text,
            "id_like_cols": self.id_like,
            "datetime_cols": self.datetime,
            "type_groups": self.type_groups,
        }


def _is_binary(col: Column) -> Column:
    # A column without values counts as binary.
    return F.coalesce(F.bool_and(col.cast("double").isin(0.0, 1.0)), F.lit(True))


def _estimated_distinct(col: Column, policy: ProfilePolicy) -> Column:
    # One binary buffer per column, so wide tables stay cheap.
    hashed = F.when(col.isNotNull(), F.xxhash64(col))
    return F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(hashed, policy.sketch_lg_k)), F.lit(0))


def _first_pass(df: DataFrame, policy: ProfilePolicy) -> tuple[int, dict[str, ColumnStats]]:
    aggs: list[Column] = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(df.schema):
        col = F.col(f.name)
        aggs += [
            F.count(col).alias(f"c{i}"),
            _estimated_distinct(col, policy).alias(f"d{i}") if not isinstance(f.dataType, T.MapType) else F.lit(0).alias(f"d{i}"),
        ]
        if is_string(f.dataType):
            aggs.append(F.avg(F.length(strip(col))).alias(f"l{i}"))
        elif is_numeric(f.dataType):
            aggs.append(_is_binary(col).alias(f"b{i}"))
    row = df.agg(*aggs).first().asDict()
    n = row["n"]
    stats = {}
    for i, f in enumerate(df.schema):
        nulls = n - row[f"c{i}"]
        stats[f.name] = ColumnStats(
            f.name,
            f.dataType.simpleString(),
            nulls,
            round(nulls / max(n, 1) * 100, 2),
            row[f"d{i}"],
            row.get(f"l{i}"),
            bool(row.get(f"b{i}", False)),
        )
    return n, stats


def _family(dtype: T.DataType) -> str:
    """Type under which values of a column are compared."""
    if isinstance(dtype, T.IntegralType):
        return "bigint"
    return "double" if isinstance(dtype, (T.DoubleType, T.FloatType)) else "string"


def distinct_counts(
    df: DataFrame, columns: list[str], stripped: bool, stats: dict[str, ColumnStats], slices: int = 1
) -> dict[str, tuple[int, int]]:
    """Exact ``(values, distinct values)`` per column, nulls left out.

    Values are exploded to one row each and grouped by column and value, which
    is merged before the shuffle. Wide text is compared by its digest. With
    ``slices`` only one hash slice of the values is looked at, complete in all
    its copies.
    """
    out = {c: (0, 0) for c in columns}
    for family in ("bigint", "double", "string"):
        names = [c for c in columns if _family(df.schema[c].dataType) == family]
        if not names:
            continue
        values = []
        for c in names:
            col = F.col(c).cast(family)
            if family == "string" and stripped:
                col = strip(col)
            values.append(F.sha2(col, 256) if (stats[c].avg_len or 0) > WIDE_TEXT else col)
        rows = df.select(F.posexplode(F.array(*values)).alias("at", "value")).filter(F.col("value").isNotNull())
        if slices > 1:
            rows = rows.filter(F.pmod(F.xxhash64("value"), F.lit(slices)) == 0)
        grouped = rows.groupBy("at", "value").agg(F.count(F.lit(1)).alias("c"))
        totals = grouped.groupBy("at").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("d"))
        for r in totals.collect():  # one row per column
            out[names[r["at"]]] = (r["n"], r["d"])
    return out


def unique_columns(
    df: DataFrame, columns: list[str], stats: dict[str, ColumnStats], n_rows: int, slice_above: int = 1_000_000
) -> list[str]:
    """Columns without a repeated value.

    On large tables one slice of the values is checked first: a repeat found
    there settles the column, so the full check runs on unique columns only.
    """
    left = list(columns)
    if n_rows > slice_above and left:
        part = distinct_counts(df, left, False, stats, SLICES)
        left = [c for c in left if part[c][0] == part[c][1]]
    full = distinct_counts(df, left, False, stats)
    return [c for c in left if full[c][0] == full[c][1]]


def build_profile(
    df: DataFrame, policy: ProfilePolicy = DEFAULT_PROFILE, count_free_text: bool = False
) -> Profile:
    """Profile with exact decisions.

    One pass over all columns with sketches settles the clear cases. Columns
    near or above a limit get an exact distinct count in a second pass, so few
    columns pay for a shuffle. ``count_free_text`` also counts text columns
    already settled by their mean length (the report shows their ratio).
    """
    df = nan_to_null(df)
    n, stats = _first_pass(df, policy)
    strings = [c for c in string_columns(df) if stats[c].nulls < n]
    long_text = [c for c in strings if (stats[c].avg_len or 0) > policy.free_text_avg_len]
    ratio_limit = policy.free_text_ratio * n * policy.screen_margin
    near_ratio = [c for c in strings if c not in long_text and stats[c].approx_distinct >= ratio_limit]
    count_text = [c for c in strings if c in long_text or c in near_ratio] if count_free_text else near_ratio
    text_distinct = {c: d for c, (_, d) in distinct_counts(df, count_text, True, stats).items()}
    free_text = [
        c
        for c in strings
        if c in long_text or (c in near_ratio and text_distinct[c] / max(n, 1) > policy.free_text_ratio)
    ]
    # Unique needs as many values as rows: at most one null and a full sketch.
    near_id = [
        c
        for c in df.columns
        if n > 0 and stats[c].nulls <= 1 and stats[c].approx_distinct >= policy.screen_margin * (n - stats[c].nulls)
    ]
    id_like = unique_columns(df, near_id, stats, n)
    return Profile(
        n_rows=n,
        n_cols=len(df.columns),
        type_groups=type_groups(df),
        stats=stats,
        distinct=text_distinct,
        high_null=[c for c in df.columns if stats[c].null_pct > policy.high_null_pct],
        free_text=free_text,
        id_like=id_like,
        datetime=datetime_columns(df),
    )


@dataclass(frozen=True)
class Recommendations:
    target: str | None
    drop: list[str]
    scale: list[str]
    encode: list[str]
    numeric: list[str]
    strings: list[str]
    reasons: dict[str, str] = field(default_factory=dict)


def recommend(
    df: DataFrame,
    target: str | None,
    policy: ProfilePolicy = DEFAULT_PROFILE,
    profile: Profile | None = None,
) -> Recommendations:
    profile = profile or build_profile(df, policy)
    reasons: dict[str, str] = {}
    for reason, columns in (
        ("high_null", profile.high_null),
        ("id_like", profile.id_like),
        ("datetime", profile.datetime),
        ("free_text", profile.free_text),
        ("deny_list", denied_columns(df, policy.deny_list, target)),
    ):
        for c in columns:
            if c != target:
                reasons.setdefault(c, reason)
    numeric, strings = numeric_columns(df), string_columns(df)
    return Recommendations(
        target=target,
        drop=list(reasons),
        scale=[c for c in numeric if c not in reasons and c != target and not profile.stats[c].binary],
        encode=[c for c in strings if c not in reasons and c not in profile.free_text and c != target],
        numeric=numeric,
        strings=strings,
        reasons=reasons,
    )


def recommendation_rows(df: DataFrame, rec: Recommendations) -> DataFrame:
    rows = (
        [("drop", i, c, rec.reasons[c]) for i, c in enumerate(rec.drop, 1)]
        + [("scale", i, c, "numeric") for i, c in enumerate(rec.scale, 1)]
        + [("encode", i, c, "string") for i, c in enumerate(rec.encode, 1)]
    )
    return df.sparkSession.createDataFrame(rows, "action string, position int, column string, reason string")


def flag_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows ``(column)`` of a per-column decision."""
    return df.sparkSession.createDataFrame([(c,) for c in columns], "column string")


def binary_columns(df: DataFrame) -> DataFrame:
    """Rows ``(column, is_binary)`` for all numeric columns."""
    df = nan_to_null(df)
    names = numeric_columns(df)
    flags = df.agg(*[_is_binary(F.col(c)).alias(f"b{i}") for i, c in enumerate(names)])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"b{i}").alias("is_binary")) for i, c in enumerate(names)]
    return flags.select(F.inline(F.array(*rows)))


def free_text_columns(df: DataFrame, policy: ProfilePolicy = DEFAULT_PROFILE) -> DataFrame:
    """Free-text columns with mean length and distinct ratio."""
    p = build_profile(df, policy, count_free_text=True)
    rows = [(c, float(p.stats[c].avg_len), p.distinct[c] / max(p.n_rows, 1)) for c in p.free_text]
    return df.sparkSession.createDataFrame(rows, "column string, avg_len double, card_ratio double").select(
        "column", F.round("avg_len", 4).alias("avg_len"), F.round("card_ratio", 4).alias("card_ratio")
    )


def profile_report(df: DataFrame, target: str | None, policy: ProfilePolicy = DEFAULT_PROFILE) -> DataFrame:
    """The text report as rows ``(section, item, metric, value)``."""
    p = build_profile(df, policy, count_free_text=True)
    rec = recommend(df, target, policy, p)
    rows: list[tuple[str, str, str, str]] = [
        ("shape", "table", "rows", str(p.n_rows)),
        ("shape", "table", "columns", str(p.n_cols)),
    ]
    rows += [("types", c, "type", t) for t, cols in p.type_groups.items() for c in cols]
    rows += [("nulls", c, "null_count", str(s.nulls)) for c, s in p.stats.items() if s.nulls]
    rows += [("nulls", c, "null_pct", f"{s.null_pct:.2f}") for c, s in p.stats.items() if s.nulls]
    rows += [("free_text", c, "avg_len", f"{p.stats[c].avg_len:.1f}") for c in p.free_text]
    rows += [("free_text", c, "card_ratio", f"{p.distinct[c] / max(p.n_rows, 1):.2f}") for c in p.free_text]
    rows += [("drop", c, "reason", r) for c, r in rec.reasons.items()]
    rows += [("scale", c, "position", str(i)) for i, c in enumerate(rec.scale, 1)]
    rows += [("encode", c, "position", str(i)) for i, c in enumerate(rec.encode, 1)]
    return df.sparkSession.createDataFrame(rows, "section string, item string, metric string, value string")


@dataclass(frozen=True)
class FieldSpec:
    name: str
    type_name: str
    nullable: bool
    null_pct: float
    description: str = ""


def field_specs(df: DataFrame, target: str | None, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Contract fields: simple type, and nullable when nulls were seen."""
    skip = {target, *excluded}
    kinds = {f.name: field_type_name(f.dataType) for f in df.schema if f.name not in skip}
    if not kinds:
        raise ValueError("no column left for the contract")
    kind = F.create_map(*[x for c, t in kinds.items() for x in (F.lit(c), F.lit(t))])
    return (
        profile_columns(df)
        .filter(F.col("column").isin(list(kinds)))
        .select(
            F.col("column").alias("name"),
            kind[F.col("column")].alias("type_name"),
            (F.col("null_pct") > 0).alias("nullable"),
            "null_pct",
        )
    )


def collect_field_specs(df: DataFrame, target: str | None, excluded: tuple[str, ...] = ()) -> dict[str, FieldSpec]:
    order = {c: i for i, c in enumerate(df.columns)}
    rows = sorted(field_specs(df, target, excluded).collect(), key=lambda r: order[r["name"]])
    return {
        r["name"]: FieldSpec(
            r["name"],
            r["type_name"],
            r["nullable"],
            r["null_pct"],
            f"column {r['name']} ({df.schema[r['name']].dataType.simpleString()}, nulls {r['null_pct']}%)",
        )
        for r in rows
    }


def dump_field_specs(specs: dict[str, FieldSpec]) -> str:
    return json.dumps({name: asdict(spec) for name, spec in specs.items()}, ensure_ascii=False)


def load_field_specs(text: str) -> dict[str, FieldSpec]:
    return {name: FieldSpec(**spec) for name, spec in json.loads(text).items()}


def densest_row(df: DataFrame, key: str) -> DataFrame:
    """The row with the fewest nulls, the first by ``key`` among equals."""
    nulls = sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    return df.withColumn("null_fields", nulls).orderBy("null_fields", key).limit(1)


def example_row(df: DataFrame, specs: dict[str, FieldSpec], key: str) -> dict[str, object]:
    """Values of the densest row, cast to the contract types, else text."""
    casts = {"int": "bigint", "float": "double", "bool": "boolean", "str": "string"}
    row = densest_row(df, key).select(
        *[F.coalesce(F.col(s.name).try_cast(casts[s.type_name])).alias(s.name) for s in specs.values()]
    ).first()
    if row is None:
        raise ValueError("an empty table has no example row")
    return row.asDict()
