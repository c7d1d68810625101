from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.llm import topk


def plain(rows, k=10, every=100):
    good = []
    for n, (i, x) in enumerate(rows):
        if x is None or any(c is None or not math.isfinite(1024 * c) for c in x):
            continue
        good.append((n, i, [math.floor(1024 * c) for c in x]))
    out = {}
    for n, i, x in good:
        if i is None or i % every:
            continue
        scores = [(-sum(a * b for a, b in zip(x, y, strict=True)), j is None, j or 0) for m, j, y in good if m != n and len(y) == len(x)]
        out.setdefault(i, []).append([(s, None if z else j) for s, z, j in sorted(scores)[:k]])
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_rows(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    want = plain(rows)
    assert set(got) == {q for q, lists in want.items() if lists[0]}
    for q, found in got.items():
        if len(want[q]) == 1:
            assert [(s, j) for _, s, j in sorted(found)] == want[q][0]
            assert [r for r, _, _ in sorted(found)] == list(range(1, len(found) + 1))


@pytest.mark.parametrize("offset", [0.0, 50.0, 1e5])
def test_brute_force(spark, offset):
    draw = np.random.default_rng(4)
    rows = [(i, (draw.normal(0, 0.2, 12) + offset).tolist()) for i in range(700)]
    check(spark, rows)


def test_ties_and_clusters(spark):
    rows = [(i, [float(i % 3), 1.0, 0.0]) for i in range(400)]
    check(spark, rows)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (100, None), (200, [1.0, None]), (300, [float("nan"), 1.0]), (400, [float("inf"), 1.0])]
    rows += [(500, []), (501, []), (600, [1.0]), (7, [0.5, 0.5]), (None, [3.0, 3.0]), (8, [-1.0, 0.0]), (700, [1e308, 1.0])]
    check(spark, rows)


def test_huge_components(spark):
    rows = [(i, [1e9 + i, -2e9, 3e9]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    first = topk.top_rows(df).where("query_id = 0").orderBy("rank").collect()
    assert len(first) == 10 and all(r["score"] == 2**63 - 1 for r in first)
    assert [r["vec_id"] for r in first] == list(range(1, 11))


def test_repeated_ids(spark):
    rows = [(100, [1.0, 0.0]), (100, [2.0, 0.0]), (1, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_rows(df).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in got) == [(1, 100), (1, 100), (2, 1), (2, 1)]


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_rows(df).collect() == []
    assert topk.exact_top_k(df, F.lit(True)).columns == ["query_id", "rank", "id", "score"]
