from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.llm import negatives


def plain(rows, every=100, positives=5, k=10):
    """anchor, positive, rank, negative and their scores by sorting everything."""
    good = []
    for n, (i, label, x) in enumerate(rows):
        if label is None or x is None or any(c is None or not math.isfinite(256 * c) for c in x):
            continue
        good.append((n, i, label, [math.floor(256 * c) for c in x]))
    out = []
    for n, i, label, x in good:
        if i is None or i % every:
            continue
        score = [(-sum(a * b for a, b in zip(x, y, strict=True)), j is None, j or 0, m, other) for m, j, other, y in good if m != n and len(y) == len(x)]
        score.sort()
        for s, z, p, _, _ in [r for r in score if r[4] == label][:positives]:
            fits = [r for r in score if r[4] != label and 30 * -s <= 100 * -r[0] <= 90 * -s][:k]
            out += [(i, None if z else p, rank + 1, None if r[1] else r[2], -s, -r[0]) for rank, r in enumerate(fits)]
    return sorted(out, key=repr)


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    found = negatives.hard_negatives(df.repartition(3), F.col("id") % 100 == 0, **options)
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert got == plain(rows)
    return got


def cloud(seed, n, dim, labels, around=0.0):
    draw = np.random.default_rng(seed)
    centre = draw.normal(0, 1, (labels, dim))
    return [(i, int(c), (centre[c] + draw.normal(0, 0.7, dim) + around).tolist()) for i, c in enumerate(draw.integers(0, labels, n))]


@pytest.mark.parametrize("options", [{}, {"most_broadcast": 0}])
def test_brute_force(spark, options):
    assert check(spark, cloud(1, 1500, 8, 4), **options)
    check(spark, cloud(2, 700, 3, 30, around=20.0), **options)


def test_many_groups_and_slices(spark, monkeypatch):
    monkeypatch.setattr(negatives, "GROUP_ANCHORS", 2)
    monkeypatch.setattr(negatives, "SLICE_ROWS", 200)
    monkeypatch.setattr(negatives, "MEMBERS", 3)
    assert check(spark, cloud(3, 1100, 5, 3), most_broadcast=0)


@pytest.mark.parametrize("options", [{}, {"most_broadcast": 0}])
def test_odd_vectors(spark, options):
    rows = [(0, 1, [1.0, 2.0]), (100, 1, None), (200, 1, [1.0, None]), (300, 1, [float("nan"), 1.0]), (400, 2, [float("inf"), 1.0])]
    rows += [(500, 1, []), (501, 2, []), (600, 1, [1.0]), (7, 1, [0.5, 0.5]), (None, 1, [3.0, 3.0]), (8, 2, [1.0, 1.0]), (700, 1, [1e308, 1.0])]
    rows += [(800, None, [1.0, 1.0]), (9, 2, [0.5, 1.0]), (0, 1, [1.0, 2.0]), (9, 2, [0.5, 1.0]), (900, 3, [0.0, 0.0]), (None, 4, [1.0, 1.0])]
    assert check(spark, rows, **options)


def test_ties_and_copies(spark):
    rows = [(i, i % 2, [1.0, 0.0, 1.0] if i % 2 else [2.0, 0.0, 1.0]) for i in range(900)]
    rows += [(1000 + i, 1, [1.0, 1.0, 1.0]) for i in range(300)]
    assert check(spark, rows)


def test_huge_components(spark):
    rows = [(i, i % 2, [1e6 + i, -2e6, 3e6 - i]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = negatives.hard_negatives(df, F.col("id") % 100 == 0, band=(50, 100)).collect()
    exact = {i: [math.floor(256 * c) for c in x] for i, _, x in rows}
    assert got and all(r["negative_score"] == sum(a * b for a, b in zip(exact[r["anchor_id"]], exact[r["negative_id"]], strict=True)) for r in got)


def test_lists_end_early():
    """With clear clusters most of a list is never scored, and nothing is missed."""
    draw = np.random.default_rng(5)
    centre = np.eye(16)[:8] * 400
    of = draw.integers(0, 8, 4000)
    v = np.floor(centre[of] + draw.normal(0, 10, (4000, 16)))
    rows = negatives.Block(np.arange(4000), np.arange(4000), np.zeros(4000, bool), of, v)
    members = rows.take(np.flatnonzero(of == 3)[:20])
    lists = [negatives.Lists(5, True, [negatives.LOWEST], [2**63 - 1]) for _ in range(20)]
    middle = v[of == 3].mean(axis=0)
    cluster = negatives.Cluster(members, lists, middle / np.sqrt((middle * middle).sum()))
    scored = negatives.walk(cluster, rows, rows.norm)
    assert scored < 0.4 * 20 * 4000
    for m, found in enumerate(lists):
        scores = v @ members.v[m]
        others = (of == 3) & (rows.row != members.row[m])
        assert found.best[0][:, 0].tolist() == sorted(scores[others].astype(int), reverse=True)[:5]


def test_bounds_are_sure():
    draw = np.random.default_rng(6)
    for scale in (1, 50, 1e6):
        v = np.floor(draw.normal(0, scale, (500, 6)))
        q = np.floor(draw.normal(scale, scale, (12, 6)))
        centre = q.mean(axis=0) / max(1e-9, np.sqrt((q.mean(axis=0) ** 2).sum()))
        norm, size = np.sqrt((v * v).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
        width = negatives.angles(q, size, centre).max()
        gap = np.maximum(0, negatives.angles(v, norm, centre) - width - 1e-7)
        bound = size[None, :] * (norm * np.cos(gap))[:, None] + 1e-9 * size[None, :] * norm.max() + 1
        assert (v @ q.T <= bound).all()


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert negatives.negative_rows(df).collect() == []
    one = spark.createDataFrame([(100, 1, [1.0])], "vec_id long, label int, embedding array<float>")
    assert negatives.negative_rows(one).collect() == []


def test_moved_labels(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("rank", F.lit(1)).withColumn("row_no", F.lit("x"))
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in df.collect()]
    assert sorted((tuple(r) for r in negatives.negative_rows(df).collect()), key=repr) == plain(rows)
