from __future__ import annotations

import collections

from calibra.llm import mixing
from tests.llm.brute import WORD


def plain_targets(sizes, weights=(1, 2, 3), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = sum(sizes.values()), set(order), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > cap * sizes[s]}
        if not full:
            return out | share
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= full
    return out


def check(docs, rows):
    size = [len(WORD.findall(r["text"] or "")) for r in docs]
    total = collections.Counter()
    for r, n in zip(docs, size, strict=True):
        total[r["source"]] += n
    want = plain_targets(total)
    source = {(r["doc_id"], n): r["source"] for r, n in zip(docs, size, strict=True)}
    taken, largest = collections.Counter(), collections.Counter()
    for r in rows:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == total[s]
        assert abs(r["target"] - want[s]) <= 1e-6 * max(1, want[s])
        assert r["taken"] % max(1, r["size"]) == 0 and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    assert sorted((r["doc_id"], r["size"]) for r in rows) == sorted((r["doc_id"], n) for r, n in zip(docs, size, strict=True))
    for s in total:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6


def test_documents(documents):
    rows = mixing.mix_rows(documents).collect()
    check(documents.collect(), rows)
    again = mixing.mix_rows(documents.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_hot_source_and_caps(spark):
    rows = [(i, "w " * (i % 17 + 1), "big" if i % 3 else "mid") for i in range(3000)]
    rows += [(5000 + i, "tiny words here", None) for i in range(3)] + [(6000, "", "none"), (6001, None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_rows(docs).collect()
    check(docs.collect(), out)
    assert {r["target"] for r in out if r["doc_id"] >= 6000} == {0.0}


def test_odd_rows(odd_docs):
    plain = odd_docs.where("doc_id is not null and doc_id not in (5)")
    check(plain.collect(), mixing.mix_rows(plain).collect())
    assert mixing.mix_rows(odd_docs).count() == odd_docs.count()


def test_expectation_is_kept(spark):
    docs = spark.createDataFrame([(i, "a b c", "x" if i < 300 else "y") for i in range(600)], "doc_id long, text string, source string")
    counts = [mixing.mix_sources(docs, seed=s).where("source = 'x'").groupBy("copies").count().collect() for s in (1, 2)]
    for c in counts:  # x has a third of the words: 600 of 900 taken words are not its own
        assert sum(r["copies"] * r["count"] for r in c) == 200


def test_documents_are_repeated(odd_docs):
    plain = odd_docs.where("doc_id < 5")
    plan = {r["key"]: r["copies"] for r in mixing.mix_sources(plain).collect()}
    got = collections.Counter(r["doc_id"] for r in mixing.mixed_documents(plain).collect())
    assert got == {k: n for k, n in plan.items() if n}
    assert mixing.mixed_documents(plain).columns == plain.columns


def test_empty(no_docs):
    assert mixing.mix_rows(no_docs).collect() == []
    assert mixing.mixed_documents(no_docs).collect() == []


def test_rows_alike_are_rounded_one_by_one(spark, monkeypatch):
    """A null key with most rows, alike in size but not in text: the source misses its target by less than a document."""
    monkeypatch.setattr(mixing, "BLOCK", 64)
    rows = [(None, f"w{i} " * 10, "a") for i in range(3001)] + [(i, "v " * (i % 7 + 1), "b") for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = mixing.mix_sources(docs).collect()
    assert len(out) == len(rows)
    for s in ("a", "b"):
        mine = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) < 10
    alike = collections.Counter(r["copies"] for r in out if r["key"] is None)
    assert len(alike) == 2 and max(alike) - min(alike) == 1
    got = collections.Counter(r["text"] for r in mixing.mixed_documents(docs).where("doc_id is null").collect())
    times = collections.Counter(got.values())
    times[0] = 3001 - len(got)
    assert +times == alike
