"""Cleaning, profile, exploration and quantiles on small frames."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.config import ProfilePolicy
from calibra.functions.text import fixed, slugify
from calibra.operators import clean, explore, ordering, profile, quantiles
from calibra.operators.quantiles import exact_quantiles
from calibra.sources.tables import LINE, read_csv_batch, resolve_path


def test_strip_blank_and_nan(spark):
    df = spark.createDataFrame([(" \t a  ", 1.0), (" ", float("nan")), (None, 2.0)], "s string, x double")
    rows = clean.normalize_strings(clean.nan_to_null(df)).collect()
    assert [(r.s, r.x) for r in rows] == [("a", 1.0), (None, None), (None, 2.0)]


def test_clean_order_and_counts(spark):
    df = spark.createDataFrame([("a", "x"), ("a ", "x"), ("b", None), ("c", " ")], "s string, t string")
    assert clean.clean(df, "t").collect() == [("a", "x")]
    row = clean.cleaning_counts(df, "t").first()
    assert (row.original_rows, row.deduplicated_rows, row.cleaned_rows) == (4, 3, 1)
    with pytest.raises(ValueError, match="target"):
        clean.clean(df, "nope")


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, None, None, 5), (1, None, 3, 6)], "a int, b int, c int, d int")
    assert clean.find_constant_columns(df) == ["a", "b"]
    assert clean.drop_constant_columns(df)[0].columns == ["c", "d"]


def test_deny_list_keeps_order_and_target(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert clean.denied_columns(df, ("c", "zz", "a", "b"), "a") == ["c", "b"]


def test_profile_thresholds(spark):
    rows = [(i, "short" if i % 2 else None, f"v{i}", "x" * 40, i % 2, None if i < 6 else 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, half string, uniq string, longtext string, bit int, rare double")
    p = profile.build_profile(df)
    assert p.high_null == ["rare"]
    assert p.free_text == ["uniq", "longtext"]
    assert p.id_like == ["id", "uniq"]
    rec = profile.recommend(df, None, ProfilePolicy(deny_list=("bit",)))
    assert rec.drop == ["rare", "id", "uniq", "longtext", "bit"]
    assert rec.scale == [] and rec.encode == ["half"]


def test_id_like_counts_null_as_value(spark):
    df = spark.createDataFrame([(1, None), (2, None), (None, 3)], "a int, b int")
    assert profile.build_profile(df).id_like == ["a"]


def test_field_specs_round_trip(spark):
    df = spark.createDataFrame([(1, None, True, "a"), (2, 2.0, False, None)], "i int, f double, b boolean, s string")
    specs = profile.collect_field_specs(df, None)
    assert {k: (v.type_name, v.nullable) for k, v in specs.items()} == {
        "i": ("int", False),
        "f": ("float", True),
        "b": ("bool", False),
        "s": ("str", True),
    }
    assert profile.load_field_specs(profile.dump_field_specs(specs)) == specs
    assert profile.example_row(df, specs, "i") == {"i": 1, "f": None, "b": True, "s": "a"}
    with pytest.raises(ValueError):
        profile.example_row(df.filter("i > 5"), specs, "i")


def test_correlation_equals_numpy(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(1e6, 3, (500, 5))
    data[:, 3] = data[:, 0] * 2
    data[:, 4] = 7.1
    rows = [tuple(None if (i + j) % 11 == 0 else float(v) for j, v in enumerate(r)) for i, r in enumerate(data)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(4)
    names = list("abcde")
    table = np.array([[np.nan if v is None else v for v in r] for r in rows])
    for chosen in (names, names[:2], names[2:]):
        found = {(r.column_i, r.column_j): r["corr"] for r in explore.correlation_matrix(df, chosen).collect()}
        assert len(found) == len(chosen) * (len(chosen) - 1) // 2
        for (a, b), value in found.items():
            x, y = table[:, names.index(a)], table[:, names.index(b)]
            both = ~np.isnan(x) & ~np.isnan(y)
            if "e" in (a, b):
                assert value is None
            else:
                assert math.isclose(value, np.corrcoef(x[both], y[both])[0, 1], abs_tol=1e-9)
    assert explore.drop_correlated_columns(df, 0.95)[1] == ["d"]


def test_correlation_prune_is_not_greedy(spark):
    rows = [(float(i), 2.0 * i, 3.0 * i) for i in range(10)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    assert explore.drop_correlated_columns(df)[1] == ["b", "c"]
    assert explore.drop_correlated_columns(df.select("a"))[1] == []


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 101])
def test_exact_quantiles_small(spark, n):
    rng = np.random.default_rng(n)
    values = rng.integers(0, max(2, n // 2), n).astype(float)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    row = exact_quantiles(df, ["x"], [0.25, 0.5, 0.75]).first()
    assert [row.q0, row.q1, row.q2] == pytest.approx(np.quantile(values, [0.25, 0.5, 0.75]))


def test_exact_quantiles_by_many_rounds(spark):
    """Brackets that may hold few values: ranges narrow round by round to the same values."""
    rng, few = np.random.default_rng(3), 4
    rows = [(k, float(np.exp(rng.normal(0, 40)) * rng.choice([-1, 1])), float(rng.integers(0, 5)), None if i % 3 else float(i)) for k in ("a", None, "b") for i in range(300)]
    rows += [("b", 7.0, 7.0, 7.0)] * 600 + [("one", 1.5, None, None)]
    df = spark.createDataFrame(rows, "k string, x double, y double, n double")
    probs = [0.0, 0.25, 0.5, 0.999]
    got = {(r["k"], r["column"]): [r["n"]] + [r[f"q{i}"] for i in range(4)] for r in exact_quantiles(df, ["x", "y", "n"], probs, ["k"], accuracy=20, few=few).collect()}
    for k in ("a", None, "b", "one"):
        for i, c in enumerate("xyn", 1):
            values = [r[i] for r in rows if r[0] == k and r[i] is not None]
            if values:
                assert got.pop((k, c)) == pytest.approx([len(values), *np.quantile(values, probs)], rel=1e-12)
    assert not got
    whole = exact_quantiles(df, ["x"], [0.5], accuracy=20, few=few).first()
    assert whole["q0"] == pytest.approx(np.quantile([r[1] for r in rows], 0.5), rel=1e-12)


def test_quantile_sorts_do_not_grow(spark, monkeypatch):
    """The rows that a sort of a group and column sees stay bounded while the group grows."""
    seen = []
    inner = quantiles._ranked

    def watched(counted, keys, *rest):
        seen[-1] = max(seen[-1], counted.groupBy(*keys).count().agg(F.max("count")).first()[0])
        return inner(counted, keys, *rest)

    monkeypatch.setattr(quantiles, "_ranked", watched)
    for n in (3_000, 60_000):
        seen.append(0)
        df = spark.range(n).select((F.xxhash64("id") / 1e6).alias("x"))
        row = exact_quantiles(df, ["x"], [0.5], accuracy=200, few=64).first()
        assert row.q0 == pytest.approx(df.agg(F.expr("percentile(x, 0.5)")).first()[0], rel=1e-12)
    assert seen[0] <= 2 * 64 + 2 and max(seen) <= 2 * 64 + 2


def test_exact_quantiles_loose_sketch_and_hot_value(spark):
    """A coarse sketch and one value that fills a third of a group stay exact."""
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(0, 1, 4000), np.full(2000, 0.25)])
    rows = [("hot" if i % 3 else "cold", float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(8)
    got = {r.g: [r.q0, r.q1] for r in exact_quantiles(df, ["x"], [0.1, 0.5], ["g"], accuracy=50).collect()}
    for g in ("hot", "cold"):
        want = np.quantile([v for h, v in rows if h == g], [0.1, 0.5])
        assert got[g] == pytest.approx(want)


def test_histogram_of_constant_and_null(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, 4.0)], "a double, b double")
    got = {(r.column, r.bin): r["count"] for r in explore.histograms(df).collect()}
    assert got == {("a", 0): 2, ("b", 0): 1}


def test_exploration_without_numbers_is_empty(spark):
    df = spark.createDataFrame([("a", "b")], "s string, t string")
    assert explore.exploration_metadata(df, "t").count() == 0
    assert explore.feature_pages(list("abcdefghij")) == [list("abcdefghi"), ["j"]]


def test_scatter_needs_number(spark):
    df = spark.createDataFrame([("a", 1)], "s string, x int")
    with pytest.raises(ValueError):
        explore.scatter_bins(df, ["x"], "s")


def test_slug_and_fixed(spark):
    row = spark.range(1).select(
        slugify(F.lit(" Ação/2! ")).alias("a"),
        slugify(F.lit("--")).alias("b"),
        fixed(F.lit(0.40625), 4).alias("c"),
        fixed(F.lit(0.14375), 4).alias("d"),
        fixed(F.lit(1234.5), 2).alias("e"),
    ).first()
    assert tuple(row) == ("ação_2", "target", f"{0.40625:.4f}", f"{0.14375:.4f}", "1234.50")


def test_csv_lines_bom_and_empty(spark, tmp_path):
    path = tmp_path / "batch.csv"
    path.write_text('﻿a,b\n1,\n"x ""y""",2\n', encoding="utf-8")
    rows = read_csv_batch(spark, str(path)).orderBy(LINE).collect()
    assert [tuple(r) for r in rows] == [(1, "1", None), (2, 'x "y"', "2")]
    empty = tmp_path / "empty.csv"
    empty.write_text("a,b\n")
    with pytest.raises(ValueError):
        read_csv_batch(spark, str(empty))


def test_csv_line_numbers_over_split_files(spark, tmp_path):
    for part, start in (("p1.csv", 0), ("p2.csv", 5000)):
        (tmp_path / part).write_text("n\n" + "\n".join(str(i) for i in range(start, start + 5000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        for df in (read_csv_batch(spark, str(tmp_path)), read_csv_batch(spark, str(tmp_path), slice_blocks=2)):
            assert df.rdd.getNumPartitions() > 2
            assert df.count() == 10_000 and df.filter(F.col(LINE) != F.col("n").cast("long") + 1).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sums_in_slices(spark):
    rows = spark.range(300).select((F.col("id") * 7 % 300).alias("a"), (F.col("id") % 5).alias("v"))
    want, total = {}, 0
    for a, v in sorted((i * 7 % 300, i % 5) for i in range(300)):
        want[a] = total
        total += v
    for slices in (1, 7):
        assert {r["a"]: r["b"] for r in ordering.sums_before(rows, ["a"], "v", "b", slices).collect()} == want


def test_resolve_path():
    assert resolve_path("x", "d") == "x"
    assert resolve_path(None, "d", "f", lambda p: p == "f") == "f"
    assert resolve_path(None, "d", "f", lambda p: False) == "d"


def test_uniqueness_by_slices(spark):
    df = spark.range(5000).select(
        "id",
        F.concat(F.lit("k"), F.col("id")).alias("key"),
        F.when(F.col("id") == 4999, 7).otherwise(F.col("id")).alias("one_repeat"),
        (F.col("id") / 3).alias("number"),
        (F.col("id") % 4990).alias("ten_repeats"),
        F.when(F.col("id") != 3, F.col("id")).alias("one_null"),
        F.when(F.col("id") > 3, F.col("id")).alias("four_nulls"),
    )
    p = profile.build_profile(df)
    assert p.id_like == ["id", "key", "number", "one_null"]
    sliced = profile.unique_columns(df, df.columns, p.stats, 5000, slice_above=10)
    assert sliced == ["id", "key", "number", "one_null", "four_nulls"]
