from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pytest

from calibra.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(SMALL))


def plain(docs, items, k=10):
    """For every item, in order, its rows (rank, id, score) by the formula alone."""
    counted = [(key, collections.Counter(terms(text))) for key, text in docs]
    counted = [(key, c, c.total()) for key, c in counted if c]
    total, words = len(counted), sum(n for _, _, n in counted)
    df = collections.Counter(w for _, c, _ in counted for w in c)
    out = []
    for _, text in items:
        query, found = collections.Counter(terms(text)), []
        for key, c, n in counted:
            m = 100 - 75 + (75 * n * total) // words
            score = sum(
                times * math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m))
                for w, times in query.items()
                if c[w]
            )
            if score > 0:
                found.append((-score, key is None, key or 0))
        found.sort()
        out.append([(r + 1, None if z else key, -s) for r, (s, z, key) in enumerate(found[:k])])
    return out


def got(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r["item_id"]].append((r["rank"], r["doc_id"], r["score"]))
    return {k: sorted(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(11)
    words = [f"w{int(draw.paretovariate(0.6)) % 300}" for _ in range(4000)] + ["été", "日本", "X1"]
    text = lambda n: draw.choice([" ", ", ", "\n"]).join(draw.choice([str.upper, str])(draw.choice(words)) for _ in range(n))
    docs = [(i, text(draw.choice([0, 1, 3, 20, 60, 400]))) for i in range(900)]
    docs += [(2000 + i, docs[17][1]) for i in range(120)] + [(5000, text(30_000)), (None, docs[17][1]), (6000, None)]
    draw.shuffle(docs)
    items = [(i, text(draw.choice([1, 5, 30]))) for i in range(25)] + [(90, docs[3][1]), (91, ""), (92, None), (93, "nowhere else"), (94, "W1 " * 9)]
    return docs, items


def test_terms_are_the_pattern():
    every = "".join(map(chr, range(0x180))) + "aÉ日 z \U0001f600"
    assert [t.decode() for t in lexical.terms_of(every.encode())] == terms(every)


def test_whole_search(spark, corpus):
    docs, items = corpus
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = {i: rows for (i, _), rows in zip(items, plain(docs, items), strict=True) if rows}
    assert got(lexical.search_rows(frame, asked)) == want
    assert 92 not in want and 93 not in want and len(want[94]) == 10


@pytest.mark.parametrize("size", [3, 64, 16_384])
def test_small_shards_and_pruning(monkeypatch, corpus, size):
    """Shards of any size give the same; what bounds exclude is not scored."""
    docs, items = corpus
    monkeypatch.setattr(lexical, "SHARD_DOCS", size)
    words = sorted({w.encode() for _, t in items for w in terms(t)})
    builder, rows = lexical.ShardBuilder({w: i for i, w in enumerate(words)}), []
    for key, text in docs:
        builder.add(key, text.encode() if text else None)
        if builder.full:
            rows += builder.row().to_pylist()
    rows += builder.row().to_pylist() if builder.keys else []
    total, count = sum(r["n_docs"] for r in rows), sum(r["n_terms"] for r in rows)
    df = collections.Counter()
    for r in rows:
        df.update(dict(zip(r["terms"], r["counts"], strict=True)))
    shards, scored = [lexical.Shard(r, total, count) for r in rows], 0
    for (_, text), want in zip(items, plain(docs, items), strict=True):
        query = sorted((words.index(w.encode()), n) for w, n in collections.Counter(terms(text)).items() if df[words.index(w.encode())])
        weights = np.array([n * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) for t, n in query], np.int64)
        best = lexical.Best.none(10)
        scored += sum(lexical.search(s, np.array([t for t, _ in query], np.int64), weights, best) for s in shards)
        found = zip(best.keys.tolist(), best.nulls.tolist(), best.scores.tolist(), strict=True)
        assert [(r + 1, None if z else k, s) for r, (k, z, s) in enumerate(found)] == want
    assert size < 1000 or scored < 0.5 * total * len(items)


def test_sparse_table():
    draw = np.random.default_rng(1)
    counts = [1, 2, 7, 64, 100]
    row = {
        "n_docs": 100, "n_terms": 5000, "terms": list(range(5)), "counts": counts,
        "keys": np.arange(100).tobytes(), "nulls": bytes(100), "sizes": np.full(100, 50).tobytes(),
        "docs": np.concatenate([np.sort(draw.permutation(100)[:c]) for c in counts]).astype(np.int32).tobytes(),
        "tfs": draw.integers(1, 6, sum(counts)).astype(np.int32).tobytes(),
    }
    shard = lexical.Shard(row, 100, 5000)
    for t, n in enumerate(counts):
        for a in range(n):
            for b in range(a, n + 1):
                lo, hi = shard.starts[t] + a, shard.starts[t] + b
                at, value = shard.peaks(np.array([[lo]]), np.array([[hi]]))
                assert value[0, 0] == shard.impact[lo:hi].max(initial=0)
                assert b == a or (shard.impact[at[0, 0]] == value[0, 0] and at[0, 0] == lo + shard.impact[lo:hi].argmax())


def test_lengths_do_not_overflow():
    sizes = np.array([1, 10**7, 10**7], np.int64)
    assert lexical.lengths(sizes, 10**12, 10**14).tolist() == [25 + 75 * s * 10**12 // 10**14 for s in sizes.tolist()]


def test_blocks_of_items(spark, corpus, monkeypatch):
    docs, items = corpus
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(lexical, "ITEM_BYTES", 3000)
    want = {i: rows for (i, _), rows in zip(items, plain(docs, items), strict=True) if rows}
    assert got(lexical.search_rows(frame, asked)) == want


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "A b c"), (1, "Zeile"), (None, "word"), (2, "")], "item_id long, text string")
    rows = lexical.search_rows(odd_docs.withColumn("score", odd_docs.n_chars).withColumn("rank", odd_docs.n_chars), items).collect()
    assert sorted({r["doc_id"] for r in rows if r["item_id"] is None}) == [4]
    assert sorted(r["doc_id"] for r in rows if r["item_id"] == 1) == [5, 5, 5, 5, 6, 7]
    assert lexical.search_rows(no_docs, items).collect() == []
    assert lexical.search_rows(odd_docs, items.limit(0)).collect() == []
