from __future__ import annotations

import collections
import random

from calibra.llm import forest
from tests.llm.brute import classes, links, shingles


def check(docs, texts):
    pairs = links(texts)
    want, count = classes(texts, pairs), collections.Counter(k for p in pairs for k in p)
    rows = forest.jaccard_rows(docs).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows} == {k: (want[k], count[k]) for k in texts}
    assert len(rows) == len(texts)


def edited(draw, words, n):
    out = list(words)
    for _ in range(n):
        out[draw.randrange(len(out))] = f"new{draw.random()}"
    return " ".join(out)


def test_documents(documents, texts):
    check(documents, texts)


def test_near_copies(spark):
    draw, rows = random.Random(8), []
    for family in range(60):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.randint(6, 300))]
        for _ in range(draw.randint(1, 5)):
            rows.append((len(rows), edited(draw, words, draw.randint(0, 1 + len(words) // 60))))
    check(spark.createDataFrame(rows, "doc_id long, text string"), dict(rows))


def test_large_group_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK", 16)
    draw = random.Random(9)
    words = [f"w{draw.randrange(900)}" for _ in range(150)]
    rows = [(i, edited(draw, words, draw.randint(0, 2))) for i in range(120)] + [(500 + i, "a short copied text of some words") for i in range(40)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), dict(rows))


def test_depth_keeps_recall():
    depth = forest.prefix_depth()
    assert 1 - (1 - 0.8**depth) ** forest.TREES >= forest.RECALL
    assert 1 - (1 - 0.8 ** (depth + 1)) ** forest.TREES < forest.RECALL or depth == forest.DEPTH


def test_signatures_estimate_jaccard():
    draw, maker = random.Random(1), forest.Shingler(5, 400, 1)
    words = [f"w{i}" for i in range(200)]
    a, b = " ".join(words), edited(draw, words, 6)
    same = (maker.prefixes(maker.runs(a.encode())) == maker.prefixes(maker.runs(b.encode()))).mean()
    x, y = shingles(a), shingles(b)
    assert abs(same - len(x & y) / len(x | y)) < 0.08


def test_connected(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (300, 300)]
    got = {r["no"]: r["of"] for r in forest.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 200: 100, 150: 100, 300: 300}


def test_one_of_each(documents, texts):
    want = classes(texts, links(texts))
    kept = sorted(r["doc_id"] for r in forest.one_of_each(documents).collect())
    assert kept == sorted({*want.values()} | {k for k, t in texts.items() if not shingles(t)})
    assert forest.one_of_each(documents).columns == documents.columns


def test_odd_rows(odd_docs, no_docs):
    rows = forest.jaccard_rows(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = collections.defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add((r["class_id"], r["n_links"]))
    assert by[0] == {(0, 0)} and by[2] == {(2, 0)}
    assert by[5] == by[6] == {(5, 4)} and by[None] == {(None, 1)}
    kept = forest.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [
        *[(False, i) for i in (0, 1, 2, 3, 4, 5, 7, 8)], (True, 0)
    ]
    assert forest.jaccard_rows(no_docs).collect() == [] and forest.one_of_each(no_docs).collect() == []
