"""Class tiers, weights, purge, splits, folds and weights."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from calibra.config import TierPolicy, TrainPolicy
from calibra.operators import classes, ranking, split
from calibra.operators.ranking import rank_cuts, with_hash


@pytest.mark.parametrize(
    "pct, tier", [(46.0, "A"), (15.0, "A"), (5.0, "B"), (1.0, "B"), (0.5, "C"), (0.1, "C"), (0.01, "D")]
)
def test_tier_limits(spark, pct, tier):
    assert spark.range(1).select(classes.tier_of(F.lit(pct))).first()[0] == tier


def test_any_number_of_tiers(spark):
    policy = TierPolicy(thresholds=(("low", 1.0), ("top", 50.0), ("mid", 10.0)), discard_label="out")
    values = [60.0, 20.0, 2.0, 0.5]
    df = spark.createDataFrame([(v,) for v in values], "p double")
    got = {r.p: r.t for r in df.select("p", classes.tier_of(F.col("p"), policy).alias("t")).collect()}
    assert got == {60.0: "top", 20.0: "mid", 2.0: "low", 0.5: "out"}


def test_published_weights(spark):
    """16280 of 35318 rows: 46.0955 percent, weight over 35053 retained rows in 14 classes."""
    rest = 35053 - 16280
    counts = [("10", 16280)] + [(f"c{i}", rest // 13 + (1 if i < rest % 13 else 0)) for i in range(13)] + [("tail", 265)]
    df = spark.createDataFrame(counts, "class string, count long")
    shares = {r["class"]: r.percentage for r in classes.with_percentage(df).collect()}
    assert shares["10"] == 46.0955
    weights = {r["class"]: r.weight for r in classes.with_weights(df.filter("class <> 'tail'")).collect()}
    assert weights["10"] == 0.153795


def test_null_is_a_class(spark):
    df = spark.createDataFrame([("a",), (None,), (None,)], "t string")
    got = [(r["class"], r["count"], r.percentage) for r in classes.class_distribution(df, "t").collect()]
    assert got == [("__null__", 2, 66.6667), ("a", 1, 33.3333)]
    kept = classes.purge_rows(df, "t", TierPolicy(min_percentage=50.0))
    assert [r.t for r in kept.collect()] == [None, None]


def test_purge_of_reports(spark, reports):
    policy = TierPolicy(min_percentage=15.0)
    kept = classes.purge_rows(reports, "code", policy)
    assert sorted(r.code for r in kept.select("code").distinct().collect()) == [101, 102, 103]
    meta = classes.purge_metadata(reports, "code", policy).first()
    assert (meta.original_class_count, meta.retained_class_count, meta.removed_class_count) == (13, 3, 10)
    assert meta.retained_rows == kept.count()
    assert meta.retained_rows + meta.removed_rows == reports.count()
    registry = classes.class_registry(reports, "code", policy).collect()
    weights = [r.weight for r in registry]
    assert weights == sorted(weights)
    lost = classes.registry_discarded(reports, "code", policy)
    assert lost.agg(F.sum("total_rows")).first()[0] == meta.removed_rows


def test_registry_document(spark, reports):
    doc = json.loads(classes.registry_document(reports, "code", TierPolicy(min_percentage=15.0)).first()[0])
    assert doc["retained_class_count"] == 3 and len(doc["classes"]) == 3
    assert doc["classes"][0]["class"] == "101" and doc["tier_thresholds"] == {"A": 15.0, "B": 1.0, "C": 0.1}
    assert sum(t["class_count"] for t in doc["discarded_summary_by_tier"]) == 10


def test_missing_target(spark, reports):
    for run in (classes.class_distribution, classes.purge_rows):
        with pytest.raises(ValueError):
            run(reports, "nope")


def test_empty_table(spark, reports):
    none = reports.filter("id < 0")
    assert classes.class_registry(none, "code").count() == 0
    assert classes.registry_summary(none, "code").first().total_rows == 0


def test_rank_cuts_match_a_full_sort(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 5)).alias("k"))
    hashed = with_hash(df, 7, ["id"]).cache()
    order: dict[str, list[str]] = {}
    for r in hashed.collect():
        order.setdefault(r.k, []).append(r["__hash"])
    wanted = [("hot", 1), ("hot", 777), ("hot", 2000), ("c0", 5)]
    for digits in (1, 3):
        cuts = rank_cuts(hashed, "k", spark.createDataFrame(wanted, "k string, rank long"), digits=digits)
        got = {(r.k, r["rank"]): r.cut for r in cuts.collect()}
        assert got == {(k, n): sorted(order[k])[n - 1] for k, n in wanted}


def test_stratified_split_sizes(spark):
    rows = [(i, "a" if i < 540 else "b" if i < 595 else "c") for i in range(645)]
    df = spark.createDataFrame(rows, "id int, k string")
    out = split.stratified_split(df, "k", ["id"])
    got = {r.k: r.t for r in out.filter("is_test").groupBy("k").agg(F.count("*").alias("t")).collect()}
    assert got == {"a": 108, "b": 11, "c": 10}
    assert out.count() == 645
    again = split.stratified_split(df.repartition(7), "k", ["id"])
    assert out.exceptAll(again.select(out.columns)).count() == 0


def test_lite_split_takes_at_least_one(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id int, k string")
    got = {r.k: r.t for r in split.lite_split(df, "k", ["id"]).filter("is_test").groupBy("k").agg(F.count("*").alias("t")).collect()}
    assert got == {"a": 1, "b": 1}


def test_folds_are_disjoint_and_even(spark, reports):
    folded = split.kfold(reports, "code", ["id"], 5)
    assert folded.count() == reports.count()
    sizes = folded.groupBy("code", "fold").count().groupBy("code").agg((F.max("count") - F.min("count")).alias("d"))
    big = sizes.join(reports.groupBy("code").count().filter("count >= 5"), "code")
    assert big.agg(F.max("d")).first()[0] <= 1
    assert split.fold_count(5, 3) == 3 and split.fold_count(5, 1) == 2


def test_weights_are_balanced(spark, reports):
    out = split.sample_weights(reports, "code")
    sums = [r.s for r in out.groupBy("code").agg(F.sum("weight").alias("s")).collect()]
    assert all(math.isclose(s, sums[0], rel_tol=1e-9) for s in sums)


def test_training_classes_and_errors(spark, reports):
    policy = TrainPolicy(target="code", min_percentage=15.0)
    table = {r.code: (r.label, r.quota) for r in split.class_table(reports, policy).collect()}
    assert sorted(table) == [101, 102, 103] and [table[c][0] for c in sorted(table)] == [0, 1, 2]
    out = split.prepare_split(reports, policy, ["id"])
    kept = out.count()
    assert out.filter("is_test").count() == math.ceil(kept * 0.2) == sum(q for _, q in table.values())
    with pytest.raises(ValueError, match="minimum share"):
        split.class_table(reports, TrainPolicy(target="code", min_percentage=99.0))
    with pytest.raises(ValueError, match="enough rows"):
        split.class_table(reports, TrainPolicy(target="code", min_class_count=10_000))
    with pytest.raises(ValueError):
        split.class_table(reports, TrainPolicy(target="nope"))


def test_encode_target_types(spark):
    df = spark.createDataFrame([("b", True, 7), ("a", False, 9)], "s string, b boolean, n int")
    assert {r.s: r.label for r in split.encode_target(df, "s").collect()} == {"a": 0, "b": 1}
    assert {r.s: r.label for r in split.encode_target(df, "b").collect()} == {"a": 0, "b": 1}
    assert {r.s: r.label for r in split.encode_target(df, "n").collect()} == {"a": 9, "b": 7}
    untidy = spark.createDataFrame([(1, " x"), (2, "x "), (3, " "), (4, None), (5, "a")], "i int, s string")
    got = {r.i: r.label for r in split.encode_target(untidy, "s").collect()}
    assert got == {1: 2, 2: 2, 3: 0, 4: 0, 5: 1}


def test_boolean_class_names(spark):
    df = spark.createDataFrame([(True,), (False,), (True,)], "t boolean")
    assert [r["class"] for r in classes.class_distribution(df, "t").collect()] == ["True", "False"]
    assert classes.purge_rows(df, "t", TierPolicy(min_percentage=50.0)).count() == 2


def test_shared_keys_stay_together(spark):
    """A third of the rows have one key: no error, and the key is not torn apart."""
    df = spark.createDataFrame([(0 if i % 3 == 0 else i, "a") for i in range(900)], "id int, k string")
    out = split.stratified_split(df, "k", ["id"])
    assert out.count() == 900
    assert out.filter("id = 0").select("is_test").distinct().count() == 1


def test_no_share_limit(spark, reports):
    policy = TrainPolicy(target="code", min_percentage=0.0)
    assert split.class_table(reports, policy).count() == 13
    assert classes.purge_rows(reports, "code", TierPolicy(min_percentage=0.0)).count() == reports.count()
    doc = json.loads(classes.registry_document(reports, "code", TierPolicy(min_percentage=0.0)).first()[0])
    assert doc["retained_class_count"] == 13


def test_quotas_of_very_large_classes(spark):
    sizes = spark.createDataFrame([("a", 10**11), ("b", 3 * 10**11 + 1), ("c", 7)], "k string, count bigint")
    quotas = {r["k"]: r["quota"] for r in split.test_quotas(sizes, "k", 0.2).collect()}
    assert quotas["a"] == 2 * 10**10 and abs(quotas["b"] - 6 * 10**10) <= 1 and quotas["c"] in (1, 2)
    assert sum(quotas.values()) == -(-(4 * 10**11 + 8) // 5)


def test_null_target_keeps_its_rows(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "k string")
    weights = [(r["k"], r["weight"]) for r in split.sample_weights(df, "k").collect()]
    assert len(weights) == 5 and {k: round(w, 6) for k, w in weights} == {"a": 0.833333, "b": 1.666667, None: 0.833333}
    assert split.with_label(df, "k").count() == 5


def test_radix_rounds_find_the_same_cuts(spark, monkeypatch):
    """However few rows a last bucket may hold, the ranks are those of one sort."""
    assert ranking.radix_rounds(1 << 29) == 1 and ranking.radix_rounds(1 << 31) == 2 and ranking.radix_rounds(10**14) == 3
    rows = [(i, "a" if i % 3 else "b") for i in range(700)] + [(10_000, "a")] * 30
    hashed = ranking.with_hash(spark.createDataFrame(rows, "id int, c string"), 7, ["id"])
    order = {c: sorted(r["__hash"] for r in hashed.collect() if r["c"] == c) for c in "ab"}
    wanted = [("a", 1), ("a", 50), ("a", 200), ("a", len(order["a"])), ("b", 3), ("b", 120)]
    sizes = []
    inner = ranking._inside
    monkeypatch.setattr(ranking, "_inside", lambda hashed, open_, bound, done: sizes.append(done) or inner(hashed, open_, bound, done))
    for rows_left, digits in ((1 << 18, 3), (20, 1), (1, 1)):
        monkeypatch.setattr(ranking, "BUCKET_ROWS", rows_left)
        cuts = ranking.rank_cuts(hashed, "c", spark.createDataFrame(wanted, "c string, rank long"), digits=digits, largest=500).collect()
        assert sorted((r["c"], r["rank"], r["cut"]) for r in cuts) == sorted((c, n, order[c][n - 1]) for c, n in wanted)
    assert sizes == [0, 0, 1, 0, 1, 2]
