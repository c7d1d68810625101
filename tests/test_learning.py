"""Neighbours, resampling, features, metrics, selection."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from calibra.config import PreparePolicy
from calibra.operators import features, hashed, metrics, neighbors, resample, selection, wide
from calibra.operators.training import build_registry, fit_classifier, load_classifier, save_classifier
from calibra.sources import artifacts


def brute(points, k, group=None, skip_self=True):
    out = {}
    for i, a in points.items():
        near = sorted(
            (math.dist(a, b), j)
            for j, b in points.items()
            if not (skip_self and i == j) and (group is None or group[i] == group[j])
        )
        out[i] = [j for _, j in near[:k]]
    return out


@pytest.fixture(scope="module")
def cloud(spark):
    """Three clusters; a third of all rows are copies of one vector."""
    rng = np.random.default_rng(9)
    centers = rng.normal(0, 20, (3, 4))
    vectors = [tuple(float(x) for x in centers[i % 3] + rng.normal(0, 1, 4)) for i in range(200)]
    vectors += [vectors[0]] * 100
    rows = [(i, list(v), i % 3 if i < 200 else i % 2) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "id int, v array<double>, label int").repartition(5).cache()
    return df, dict(enumerate(vectors)), {i: label for i, _, label in rows}


@pytest.mark.parametrize("block, pivots", [(4096, 256), (16, 8), (16, 1)])
@pytest.mark.parametrize("grouped", [False, True])
def test_neighbors_equal_brute_force(cloud, block, pivots, grouped):
    df, points, labels = cloud
    near = neighbors.nearest(
        df, df, "id", "v", 5, group="label" if grouped else None, block=block, max_pivots=pivots
    )
    got = {r.id: [n.id for n in r.neighbors] for r in near.collect()}
    assert got == brute(points, 5, labels if grouped else None)


def test_pruning_skips_far_cells(spark, cloud):
    """Tight clusters: most queries visit the blocks of their own cluster only."""
    df, _, _ = cloud
    distinct = df.dropDuplicates(["v"])
    points = neighbors._distinct_base(neighbors._points(distinct, "id", "v", None, None), 3)
    pivots = np.array([r.vec for r in points.select("vec").limit(12).collect()])
    celled = neighbors._assign(points.select("grp", "digest", "vec", "low"), pivots)
    table = (
        celled.groupBy("grp", "cell").agg(F.max("radius").alias("radius"), F.count("*").alias("n"))
        .withColumn("blocks", F.lit(1)).toPandas()
    )
    asked = points.select("grp", "digest", "vec").withColumn("bound", F.lit(4.0))
    visits = neighbors._visits(asked, pivots, table).count()
    assert visits < 0.6 * points.count() * len(table)


def test_fewer_neighbors_than_asked(spark):
    df = spark.createDataFrame([(1, [0.0], 0), (2, [1.0], 0), (3, [5.0], 1)], "id int, v array<double>, label int")
    got = {r.id: [n.id for n in r.neighbors] for r in neighbors.nearest(df, df, "id", "v", 5, group="label").collect()}
    assert got == {1: [2], 2: [1], 3: []}


def test_knn_vote_ties_take_smaller_label(spark):
    train = spark.createDataFrame([(1, [0.0], 5), (2, [0.0], 3), (3, [9.0], 1)], "id int, v array<double>, label int")
    ask = spark.createDataFrame([(10, [0.1])], "id int, v array<double>")
    row = neighbors.knn_classify(ask, train, "id", "v", "label", 2).first()
    assert row.prediction == 3 and [(v.label, v.votes) for v in row.votes] == [(3, 1), (5, 1)]


@pytest.fixture(scope="module")
def lopsided(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 3)], "big" if i < 60 else "mid" if i < 80 else "few") for i in range(84)]
    return spark.createDataFrame(rows, "id int, v array<double>, t string").cache()


def test_smote_points_lie_on_segments(lopsided):
    source = {r.id: (r.v, r.t) for r in lopsided.collect()}
    made = resample.smote_rows(lopsided, "t", "id", "v").collect()
    for r in made:
        (a, ta), (b, tb) = source[r.source], source[r.neighbor]
        assert ta == tb == r.t and 0 <= r.step < 1
        assert r.v == pytest.approx([x + r.step * (y - x) for x, y in zip(a, b)])
    counts = {t: sum(r.t == t for r in made) for t in ("big", "mid", "few")}
    assert counts == {"big": 0, "mid": 40, "few": 56}
    again = resample.smote_rows(lopsided.repartition(3), "t", "id", "v").collect()
    assert sorted((r.source, r.copy, r.neighbor, r.step) for r in made) == sorted(
        (r.source, r.copy, r.neighbor, r.step) for r in again
    )


def test_smote_size_rules(spark, lopsided):
    with pytest.raises(ValueError):
        resample.smote_rows(lopsided, "t", "id", "v", strict=True)
    alone = spark.createDataFrame([(1, [0.0], "a"), (2, [1.0], "b"), (3, [2.0], "b")], "id int, v array<double>, t string")
    with pytest.raises(ValueError):
        resample.smote_rows(alone, "t", "id", "v")


def test_adasyn_follows_the_ratio(lopsided):
    ratios = {r.id: (r.t, r.other) for r in resample.adasyn_ratio(lopsided, "t", "id", "v").collect()}
    points = {r.id: r.v for r in lopsided.collect()}
    label = {r.id: r.t for r in lopsided.collect()}
    for i, near in brute(points, 5).items():
        if label[i] != "big":
            assert ratios[i] == (label[i], sum(label[j] != label[i] for j in near))
    made = resample.adasyn_rows(lopsided, "t", "id", "v").groupBy("t").count().collect()
    totals = {t: sum(o for s, o in ratios.values() if s == t) for t in ("mid", "few")}
    want = {
        t: sum(int(np.rint(o / totals[t] * extra)) for s, o in ratios.values() if s == t)
        for t, extra in (("mid", 40), ("few", 56))
    }
    assert {r.t: r["count"] for r in made} == want


def test_adasyn_without_mixed_neighbors(spark):
    rows = [(i, [float(i)], "a") for i in range(20)] + [(100 + i, [1000.0 + i], "b") for i in range(8)]
    df = spark.createDataFrame(rows, "id int, v array<double>, t string")
    with pytest.raises(ValueError):
        resample.adasyn_rows(df, "t", "id", "v")


def test_random_oversample_spreads_copies(lopsided):
    out = resample.random_oversample(lopsided, "t", "id")
    assert {r["count"] for r in out.groupBy("t").count().collect()} == {60}
    spread = out.groupBy("t", "id").count().groupBy("t").agg((F.max("count") - F.min("count")).alias("d"))
    assert spread.agg(F.max("d")).first()[0] <= 1


def test_strategy_names():
    assert resample.normalize_strategy(" SMOTE ") == "smote"
    assert [resample.normalize_strategy(s) for s in (None, "", "none", "Nenhum")] == [None] * 4
    with pytest.raises(ValueError):
        resample.normalize_strategy("other")


def test_trees_are_even_and_probes_come_in_order():
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(0, 1, (900, 6)), rng.normal(50, 0.1, (900, 6))])
    table = hashed.Table.fit(v, 5, 1)
    row, leaf = table.leaves(v, np.full(len(v), 5), 1)
    assert (np.sort(row) == np.arange(len(v))).all() and np.bincount(leaf).max() <= 1.2 * len(v) / 32
    for probes in (1, 2, 7, 32):
        row, leaf = table.leaves(v[:50], np.full(50, 5), probes)
        assert (np.bincount(row) == probes).all() and len(set(zip(row.tolist(), leaf.tolist(), strict=True))) == 50 * probes
    row, leaf = table.leaves(v[:3], np.array([0, 2, 5]), 32)
    assert np.bincount(row).tolist() == [1, 4, 32]


@pytest.mark.parametrize("group", [None, "g"])
def test_hashed_neighbors_reach_the_share(spark, group):
    rng = np.random.default_rng(9)
    centre = rng.normal(0, 20, (30, 6))
    points = [(i, [float(x) for x in centre[i % 30] + rng.normal(0, 1, 6)], "big" if i % 4 else f"s{i % 40}") for i in range(1500)]
    points += [(2000 + i, points[0][1], "big") for i in range(40)]
    df = spark.createDataFrame(points, "id int, v array<double>, g string")
    near = lambda share: {r["id"]: [n["id"] for n in r["neighbors"]] for r in neighbors.nearest(df, df, "id", "v", 5, group=group, block=64, approximate=share).collect()}
    exact, found = near(None), near(0.95)
    assert exact.keys() == found.keys()
    common = sum(len(set(exact[i]) & set(found[i])) for i in exact)
    assert common >= 0.92 * sum(map(len, exact.values()))
    assert near(1.0).keys() == exact.keys()


def test_hashed_neighbors_skip_most_leaves(spark, monkeypatch):
    """On clear clusters few leaves are visited, and resampling takes the option."""
    rng = np.random.default_rng(2)
    centre = rng.normal(0, 100, (64, 4))
    points = [(i, [float(x) for x in centre[i % 64] + rng.normal(0, 1, 4)], "a" if i % 8 else "b") for i in range(4096)]
    df = spark.createDataFrame(points, "id int, v array<double>, t string")
    seen, inner = [], hashed._cells
    monkeypatch.setattr(hashed, "_cells", lambda df, tables, probes, keep: seen.append(probes) or inner(df, tables, probes, keep))
    neighbors.nearest(df, df, "id", "v", 5, block=64, approximate=0.9).count()
    assert max(seen) <= 8  # of 64 leaves
    made = resample.smote_rows(df, "t", "id", "v", approximate=0.9, block=128)
    assert made.count() == 4096 - 2 * 512
    with pytest.raises(ValueError, match="between"):
        neighbors.nearest(df, df, "id", "v", 5, approximate=1.5)


def test_hashed_queries_travel_without_lists(spark, monkeypatch):
    """A query is one row for a shelf, of the same size whatever number of leaves it probes there."""
    v = np.random.default_rng(3).normal(size=(600, 8))
    df = spark.createDataFrame([(i, r) for i, r in enumerate(v.tolist())], "id int, v array<double>")
    sent, inner = [], hashed._shelf_join
    monkeypatch.setattr(hashed, "_shelf_join", lambda queries, *more: sent.append(queries) or inner(queries, *more))
    neighbors.nearest(df, df, "id", "v", 5, block=8, approximate=0.9).count()
    lists = [c for c, kind in sent[0].dtypes if kind.startswith("array") and c != "vec"]
    assert lists == [] and sent[0].groupBy("digest", "shelf").count().filter("count > 1").isEmpty()


def test_probed_leaves_follow_from_their_cost():
    rng = np.random.default_rng(6)
    v = rng.normal(size=(300, 6))
    trees = [hashed.Table.fit(v, 5, seed) for seed in range(2)]
    depth = rng.integers(0, 6, len(v))
    up = np.minimum(depth, 2)
    for probes in (2, 7, 31):
        row, node, _ = hashed._reached(trees, v, depth, up, probes)
        got = set(zip(row.tolist(), node.tolist(), strict=True))
        for no, tree in enumerate(trees):
            at, leaf = tree.leaves(v, depth, probes)
            want = {(r, (no << hashed.LEAF_BITS) + (n >> up[r])) for r, n in zip(at.tolist(), leaf.tolist(), strict=True)}
            if no:  # a row that probes every leaf needs one table
                want = {x for x in want if probes < 1 << depth[x[0]]}
            assert {x for x in got if x[1] >> hashed.LEAF_BITS == no} == want


def test_any_number_of_groups(spark, monkeypatch):
    """Small groups need no table on the driver, and large ones beside them still have cells."""
    monkeypatch.setattr(neighbors, "BROADCAST_ROW_BOUND", 20)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 5, 3)], "large" if i % 2 else f"g{i % 150}") for i in range(1200)]
    df = spark.createDataFrame(rows, "id int, v array<double>, g string")
    got = {r["id"]: [n["id"] for n in r["neighbors"]] for r in neighbors.nearest(df, df, "id", "v", 3, group="g", block=64).collect()}
    assert got == brute({i: v for i, v, _ in rows}, 3, {i: g for i, _, g in rows})


def test_reducer_choice():
    choose = lambda w, s, c=0.95: features.choose_reducer(w, s, PreparePolicy(components=c))
    assert choose(1, False) == (None, 0)
    assert choose(40, True) == ("svd", 39) and choose(2, True) == ("svd", 2) and choose(500, True) == ("svd", 128)
    assert choose(40, True, 10) == ("svd", 10) and choose(5, True, 10) == ("svd", 4)
    assert choose(40, False) == ("pca", 0.95) and choose(1500, False) == ("svd", 128)
    assert features.choose_reducer(9, False, PreparePolicy(enable_reduction=False)) == (None, 0)
    assert features.component_names("svd", 2) == ["svd_001", "svd_002"]


def test_transform_order_missing_and_unseen(spark):
    df = spark.createDataFrame(
        [(1.0, "x", 5.0), (3.0, None, None), (None, "y", 7.0)], "a double, c string, p double"
    )
    fitted = features.fit_features(df, features.FeatureGroups(["a"], ["c"], ["p"]), PreparePolicy(enable_reduction=False))
    assert fitted.names == [
        "scaled_numeric__a", "encoded_categorical__c___missing__", "encoded_categorical__c_x", "encoded_categorical__c_y",
        "passthrough_numeric__p",
    ]
    new = spark.createDataFrame([(2.0, "zz", None)], df.schema)
    assert fitted.transform(new).select(vector_to_array("features")).first()[0] == [0.0, 0.0, 0.0, 0.0, 6.0]
    std = np.std([1.0, 3.0, 2.0])
    got = [r[0] for r in fitted.transform(df).select(vector_to_array("features")).collect()]
    assert got[0] == pytest.approx([-1 / std, 0, 1, 0, 5]) and got[1] == pytest.approx([1 / std, 1, 0, 0, 6])
    wide = features.expand_features(fitted.transform(df), fitted.names)
    assert wide.columns == fitted.names and wide.filter(" OR ".join(f"`{c}` IS NULL" for c in wide.columns)).count() == 0


def test_no_feature_is_an_error(spark):
    df = spark.createDataFrame([(None,)], "a double")
    with pytest.raises(ValueError):
        features.fit_features(df, features.FeatureGroups(["a"], [], []))


def test_levels_beyond_the_list(spark, tmp_path):
    """With more levels than a list may hold, the same vectors come from a table of levels."""
    rng = np.random.default_rng(8)
    rows = [(int(i), None if i % 7 == 0 else f"k{rng.integers(0, 60)}", "xyz"[i % 3], float(rng.normal()), None if i % 5 == 0 else float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, wide string, small string, a double, p double")
    groups = features.FeatureGroups(["a"], ["wide", "small"], ["p"])
    assert features.narrow_levels(df, ["wide"], 10) is None and len(features.narrow_levels(df, ["small"], 10)["small"]) == 3
    narrow = features.fit_features(df, groups, PreparePolicy(enable_reduction=False))
    tabled = features.fit_features(df, groups, PreparePolicy(enable_reduction=False, max_width=10))
    assert tabled.width == narrow.width and tabled.wide is not None and narrow.wide is None
    assert [r["name"] for r in tabled.wide.names().orderBy("place").collect()] == narrow.names
    new = df.union(spark.createDataFrame([(999, "never seen", "x", None, None), (1000, None, None, 0.0, 0.0)], df.schema))
    values = lambda fitted, frame: {r["id"]: r["v"] for r in fitted.transform(frame).select("id", vector_to_array("features").alias("v")).collect()}
    one, two = values(narrow, new), values(tabled, new)
    assert one.keys() == two.keys() and all(two[k] == pytest.approx(one[k]) for k in one)

    narrow = features.fit_features(df, groups, PreparePolicy(components=4))
    tabled = features.fit_features(df, groups, PreparePolicy(components=4, max_width=10))
    assert tabled.explained == pytest.approx(narrow.explained, abs=1e-8) and tabled.names == narrow.names
    one, two = values(narrow, new), values(tabled, new)
    assert all(two[k] == pytest.approx(one[k], abs=1e-6) for k in one)
    artifacts.save_features(tabled, spark, f"{tmp_path}/features")
    again = artifacts.load_features(f"{tmp_path}/features")
    three = {r["id"]: r["v"] for r in again.transform(new).select("id", vector_to_array("features").alias("v")).collect()}
    assert all(three[k] == pytest.approx(two[k]) for k in two)


def test_wide_entries(spark):
    df = spark.createDataFrame([(1, Vectors.sparse(9, [2, 7], [0.5, -1.0])), (2, Vectors.dense([0.0, 3.0])), (3, Vectors.sparse(4, [], []))], ["id", "v"])
    rows = df.select("id", F.inline_outer(wide.vector_entries("v"))).collect()
    assert sorted((r["id"], r["place"], r["value"]) for r in rows if r["place"] is not None) == [(1, 2, 0.5), (1, 7, -1.0), (2, 1, 3.0)]


def test_pca_by_iteration_matches_numpy(spark):
    rng = np.random.default_rng(6)
    data = rng.normal(0, 1, (150, 30)) @ np.diag(np.linspace(6, 0.1, 30)) + 3
    rows = spark.createDataFrame([([float(x) for x in r],) for r in data], "v array<double>").select(array_to_vector("v").alias("__assembled"))
    share = np.linalg.svd(data - data.mean(0), compute_uv=False) ** 2
    _, ratios = features.fit_pca(rows, 5, 30, gram=False)
    assert ratios == pytest.approx((share / share.sum())[:5], abs=1e-8)
    stages, explained = features.fit_svd(rows, 3, 30, gram=False)
    plain, same = features.fit_svd(rows, 3, 30)
    assert explained == pytest.approx(same, abs=1e-8)
    scores = [np.array([r[0] for r in features.PipelineModel(s).transform(rows).select(vector_to_array("features")).collect()]) for s in (stages, plain)]
    assert scores[0] == pytest.approx(scores[1], abs=1e-6)


def test_pca_and_svd_match_numpy(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(0, 1, (120, 5)) @ np.diag([5, 3, 1, 0.5, 0.1]) + np.array([4, 0, 1, 0, 2])
    df = spark.createDataFrame([([float(x) for x in r],) for r in data], "v array<double>")
    rows = df.select(array_to_vector("v").alias("__assembled"))
    centred = data - data.mean(0)
    share = np.linalg.svd(centred, compute_uv=False) ** 2
    share = share / share.sum()
    _, ratios = features.fit_pca(rows, 0.95, 5)
    assert len(ratios) == int(np.searchsorted(np.cumsum(share), 0.95, side="right") + 1)
    assert ratios == pytest.approx(share[: len(ratios)], abs=1e-8)
    stages, explained = features.fit_svd(rows, 3, 5)
    _, _, vt = np.linalg.svd(data, full_matrices=False)
    vt = vt[:3] * np.sign(vt[:3][np.arange(3), np.abs(vt[:3]).argmax(1)])[:, None]
    scores = data @ vt.T
    assert explained == pytest.approx(scores.var(0) / data.var(0).sum(), abs=1e-8)
    scored = features.PipelineModel(stages).transform(rows).select(vector_to_array("features").alias("f"))
    assert np.array([r.f for r in scored.collect()]) == pytest.approx(scores, abs=1e-8)


@pytest.mark.parametrize("slice_rows", [25, 200, 200_000])
def test_ranking_metrics(spark, slice_rows, monkeypatch):
    written, inner = [], metrics.materialize
    monkeypatch.setattr(metrics, "materialize", lambda df, name: written.append(inner(df, name)) or written[-1])
    rng = np.random.default_rng(4)
    truth = rng.choice(3, 900, p=[0.7, 0.25, 0.05])
    scores = np.round(rng.random((900, 3)) + 0.4 * np.eye(3)[truth], 2)
    scores[:300, 0] = 0.5  # a third of all rows share one score
    df = spark.createDataFrame([(int(t), [float(x) for x in s]) for t, s in zip(truth, scores)], "y int, s array<double>")
    got = {r["class"]: r for r in metrics.ranking_metrics(df, "y", "s", [0, 1, 2], slice_rows).collect()}
    for table in written:  # a slice never has many more distinct scores than asked for
        assert table.groupBy("slice").count().agg(F.max("count")).first()[0] <= 2 * slice_rows
    for c in range(3):
        hit, s = truth == c, scores[:, c]
        pos, neg = s[hit], s[~hit]
        auc = np.mean([(np.sum(neg < x) + 0.5 * np.sum(neg == x)) / len(neg) for x in pos])
        ap, before = 0.0, 0.0
        for t in np.unique(s)[::-1]:
            taken = s >= t
            recall = hit[taken].sum() / hit.sum()
            ap += (recall - before) * hit[taken].sum() / taken.sum()
            before = recall
        assert got[c].roc_auc == pytest.approx(auc) and got[c].pr_auc == pytest.approx(ap)


def test_auc_edge_cases(spark):
    df = spark.createDataFrame([(0, [0.1, 0.9, 0.0]), (0, [0.5, 0.5, 0.0])], "y int, s array<double>")
    row = metrics.auc_summary(df, "y", "s", [0, 1, 2]).first()
    assert row.roc_auc is None and row.pr_auc is None
    mixed = spark.createDataFrame([(0, [0.1, 0.9]), (1, [0.5, 0.5]), (2, [0.4, 0.6])], "y int, s array<double>")
    assert metrics.auc_summary(mixed, "y", "s", [0, 1, 2]).first().roc_auc is None
    one = spark.createDataFrame([(1, [0.1, 0.9]), (1, [0.5, 0.5])], "y int, s array<double>")
    assert metrics.auc_summary(one, "y", "s", [0, 1]).first().roc_auc is None


def test_averages_and_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (2, 3)], "y int, p int")
    row = metrics.classification_metrics(df, "y", "p").first()
    assert row.multiclass and row.average == "macro"
    assert row.precision == pytest.approx(0.5 / 4) and row.recall == pytest.approx(1 / 4)
    two = metrics.classification_metrics(df.filter("y < 2"), "y", "p").first()
    assert not two.multiclass and two.average == "binary" and two.f1 == 0.0
    per_class = {r["class"]: r.support for r in metrics.per_class_metrics(df, "y", "p", [0, 1, 2]).collect()}
    assert per_class == {0: 1, 1: 1, 2: 1}


def test_tier_order(spark):
    table = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4)], "class int, support int")
    labels = spark.createDataFrame([(0, "w"), (1, "x"), (2, "y"), (3, "z")], "class int, original_class string")
    tiers = spark.createDataFrame([("w", "D"), ("y", "A"), ("z", "B")], "class string, tier string")
    got = [(r.original_class, r.tier) for r in metrics.with_labels_and_tiers(table, labels, tiers).collect()]
    assert got == [("y", "A"), ("z", "B"), ("w", "D"), ("x", None)]


def test_champion_and_gate(spark):
    schema = "seq int, resampling string, f1 double, recall double, roc_auc double"
    runs = spark.createDataFrame(
        [(0, "none", None, 0.9, 0.9), (1, "smote", 0.9, 0.1, 0.2), (2, "none", 0.9, 0.8, None)], schema
    )
    assert selection.champion(runs, "seq").first().seq == 1
    gate = selection.phase_gate(runs).first()
    assert (gate.recall_min, gate.f1_min, gate.roc_auc_min, gate.run_next_phase) == (0.8, 0.9, 0.9, False)
    only = selection.phase_gate(runs.filter("resampling = 'smote'")).first()
    assert (only.recall_min, only.run_next_phase) == (0.1, True)
    blank = spark.createDataFrame([(0, "none", 0.9, 0.9, None)], schema)
    assert selection.phase_gate(blank).first().run_next_phase


def test_parameter_sampling():
    space = {"a": [1, 2, 3], "b": [4, 5]}
    combos = selection.sample_parameters(space, 4, 1)
    assert combos == selection.sample_parameters(space, 4, 1) and len({tuple(c.items()) for c in combos}) == 4
    assert len(selection.sample_parameters(space, 99)) == 6


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(8)
    rows = [(i, i % 3, [float(i % 3) * 4 + float(x) for x in rng.normal(0, 0.5, 2)]) for i in range(150)]
    return spark.createDataFrame(rows, "id int, label int, v array<double>").select(
        "id", "label", array_to_vector("v").alias("features")
    ).cache()


@pytest.mark.parametrize("name", ["gbt", "gbt_balanced", "rf", "logreg", "knn"])
def test_every_algorithm_learns_and_reloads(spark, separable, tmp_path, name):
    quick = {"gbt": {"maxIter": 3, "maxDepth": 2}, "gbt_balanced": {"maxIter": 3, "maxDepth": 2}, "rf": {"numTrees": 5}}
    spec = build_registry(42, 3, quick)[name]
    model = fit_classifier(spec, separable, key="id")
    scored = model.transform(separable, "id")
    assert scored.filter("prediction = label").count() >= 140
    sums = scored.select(F.aggregate("probability", F.lit(0.0), lambda a, x: a + x).alias("s"), F.size("probability").alias("n"))
    assert all(r.n == 3 and r.s == pytest.approx(1.0) for r in sums.collect())
    save_classifier(model, spark, str(tmp_path / name))
    again = load_classifier(spark, str(tmp_path / name)).transform(separable, "id")
    assert {r.id: r.prediction for r in scored.collect()} == {r.id: r.prediction for r in again.collect()}


def test_cross_validation_and_search(separable):
    spec = build_registry(42, 3, {"logreg": {"maxIter": 5}})["logreg"]
    out = selection.cross_validate(spec, separable, "id", 3).summary()
    assert out["cv_folds_used"] == 3 and len(out["f1_macro"]["folds"]) == 3
    assert out["f1_macro"]["mean"] > 0.9 and out["roc_auc_macro"]["std"] >= 0
    with pytest.raises(ValueError):
        selection.search_parameters(spec, separable, "id")
    tuned, found = selection.search_parameters(
        spec, separable, "id", 2, 2, space={"regParam": [0.0, 0.1], "maxIter": [3, 5]}
    )
    assert found.n_iter == 2 and tuned.params["maxIter"] == found.best_params["maxIter"]


def test_unknown_algorithm(separable):
    from calibra.operators.training import ClassifierSpec

    with pytest.raises(ValueError):
        fit_classifier(ClassifierSpec("svm", {}, 3), separable)


@pytest.mark.parametrize("offset", [1e6, 1e8, 2e9])
def test_neighbors_with_a_large_offset(spark, offset):
    rng = np.random.default_rng(12)
    points = {i: tuple(float(x) for x in np.round(offset + rng.normal(0, 3, 4), 3)) for i in range(300)}
    df = spark.createDataFrame([(i, list(v)) for i, v in points.items()], "id int, v array<double>")
    near = neighbors.nearest(df, df, "id", "v", 5, block=16, max_pivots=8)
    assert {r.id: [n.id for n in r.neighbors] for r in near.collect()} == brute(points, 5)


def test_copies_of_two_rows_run_in_many_tasks(spark):
    rows = [(i, 0, [float(i), 0.0]) for i in range(9000)] + [(9000, 1, [1.0, 5.0]), (9001, 1, [2.0, 6.0])]
    df = spark.createDataFrame(rows, "id int, label int, v array<double>")
    made = resample.smote_rows(df, "label", "id", "v")
    parts = made.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in parts) == 8998 and len(parts) > 2
    for r in made.limit(50).collect():
        assert {r.source, r.neighbor} == {9000, 9001}
        a, b = rows[r.source][2], rows[r.neighbor][2]
        assert np.allclose(r.v, [x + r.step * (y - x) for x, y in zip(a, b)])
    counts = resample.random_oversample(df, "label", "id").groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in counts} == {0: 9000, 1: 9000}


def test_auc_counts_beyond_a_long(spark):
    rows = spark.createDataFrame([(4 * 10**9, 4 * 10**9)], "pos_all bigint, neg_all bigint")
    assert rows.select((F.col("pos_all").cast("double") * F.col("neg_all")).alias("x")).first()["x"] == 1.6e19


@pytest.mark.parametrize("group", [None, "g"])
def test_a_query_travels_once_to_a_shelf(spark, monkeypatch, group):
    """Small blocks do not multiply the rows between tasks: 600 queries went to 150 blocks."""
    monkeypatch.setattr(neighbors, "SHELF_BYTES", 8 * 6 * 100)  # 100 vectors
    seen, inner = [], neighbors._shelf_join

    def spy(queries, base, keys, *more, **options):
        seen.append((queries.count(), base.select(*keys).distinct().count()))
        return inner(queries, base, keys, *more, **options)

    monkeypatch.setattr(neighbors, "_shelf_join", spy)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 6)], i % 3) for i in range(600)]
    df = spark.createDataFrame([*rows, (600, None, 0), (601, [0.0, float("nan"), 0.0, 0.0, 0.0, 0.0], 0)], "id int, v array<double>, g int")
    got = {r["id"]: [n["id"] for n in r["neighbors"]] for r in neighbors.nearest(df, df, "id", "v", 4, group=group, block=8).collect()}
    assert got.pop(600) == got.pop(601) == []  # no vector of numbers
    assert got == brute({i: v for i, v, _ in rows}, 4, {i: g for i, _, g in rows} if group else None)
    assert all(visits <= 600 * shelves for visits, shelves in seen) and max(shelves for _, shelves in seen) <= 12


def test_levels_reduce_without_a_vector_on_the_driver(spark, monkeypatch):
    """One-hot levels: the squared singular values are their counts; nothing of the width is collected."""
    monkeypatch.setattr(features, "right_singular", lambda *_: pytest.fail("vectors of the width on the driver"))
    counts = [40, 30, 20, 12, 6] + [1] * 30
    rows = [(f"l{i}",) for i, n in enumerate(counts) for _ in range(n)]
    df = spark.createDataFrame(rows, "c string").repartition(3)
    fitted = features.fit_features(df, features.FeatureGroups([], ["c"], []), PreparePolicy(components=4, max_width=8))
    n, squares = sum(counts), sum(c * c for c in counts)
    assert fitted.explained == pytest.approx([c * (n - c) / (n * n - squares) for c in counts[:4]], abs=1e-9)
    scores = {r["c"]: r["v"] for r in fitted.transform(df).select("c", vector_to_array("features").alias("v")).distinct().collect()}
    assert scores["l1"] == pytest.approx([0, 1, 0, 0], abs=1e-7) and scores["l20"] == pytest.approx([0] * 4, abs=1e-7)


def test_vector_entries_need_no_text(spark):
    df = spark.createDataFrame([(Vectors.sparse(5, [1, 3], [2.0, 0.5]),), (Vectors.dense([0.0, 4.0]),)], ["v"])
    out = df.select(wide.vector_entries("v").alias("e"))
    assert [[tuple(x) for x in r["e"]] for r in out.collect()] == [[(1, 2.0), (3, 0.5)], [(1, 4.0)]]
    assert "json" not in out._jdf.queryExecution().toString().lower()


def test_levels_beyond_the_limit_are_seen_early(spark, monkeypatch):
    """A prefix tells that there are too many levels; it never tells that there are few."""
    seen, inner = [], features.category_levels
    monkeypatch.setattr(features, "category_levels", lambda df, columns: seen.append(df.count()) or inner(df, columns))
    many = spark.range(0, 5000, 1, 4).select(F.col("id").cast("string").alias("c"))
    assert features.narrow_levels(many, ["c"], 20) is None and seen == [320]
    late = spark.range(0, 5000, 1, 4).select(F.when(F.col("id") % 1250 < 1200, "x").otherwise(F.col("id").cast("string")).alias("c"))
    assert features.narrow_levels(late, ["c"], 20) is None and seen[1:] == [320, 5000]
    few = spark.range(0, 5000, 1, 4).select((F.col("id") % 3).cast("string").alias("c"))
    assert features.narrow_levels(few, ["c"], 20) == {"c": ["0", "1", "2"]}
