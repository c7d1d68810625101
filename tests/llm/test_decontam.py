from __future__ import annotations

import itertools
import random

import pytest

from calibra.llm import decontam
from tests.llm.brute import overlaps


def check(docs, bench, texts, items):
    rows = decontam.overlap_rows(docs, bench).collect()
    got = {(r["doc_id"], r["item_id"]): r["n_same"] for r in rows}
    want = overlaps(texts, items)
    assert got == want and len(rows) == len(want)
    kept = {r["doc_id"] for r in decontam.drop_contaminated(docs, bench).collect()}
    assert kept == set(texts) - {k for k, _ in want}
    return want


def test_documents(documents, texts, spark, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert check(documents, bench, texts, {r["item_id"]: r["text"] for r in bench.collect()})


def test_substitutions_and_long_texts(spark):
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    items = {i: " ".join(word() for _ in range(draw.randint(14, 40))) for i in range(30)}
    texts = {}
    for i in range(120):
        body = [word() for _ in range(draw.choice([0, 30, 508, 1500]))]
        part = items[i % 30].split()
        if i % 4:
            for _ in range(i % 5):
                part[draw.randrange(len(part))] = word()
            at = draw.randint(0, len(body))
            body[at:at] = [draw.choice([p.upper(), p + ",", p]) for p in part]
        texts[i] = " ".join(body)
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(sorted(items.items()), "item_id long, text string")
    found = check(docs, bench, texts, items)
    hit = {k for k, _ in found}
    assert {i for i in texts if i % 4 and i % 5 <= 1} <= hit
    assert not hit & {i for i in texts if i % 4 == 0}


def test_short_items(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (2, "one two"), (3, None), (4, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x Alpha, beta GAMMA delta epsilon y"), (2, "one two"), (3, "alpha beta"), (4, None)], "doc_id long, text string")
    got = [tuple(r) for r in decontam.overlap_rows(docs, bench).collect()]
    assert got == [(1, 1, 5, 5)]


def test_odd_rows(odd_docs, no_docs, spark):
    bench = spark.createDataFrame([(9, "a b c d e f g h i j k l m n o p"), (9, "word " * 20)], "item_id long, text string")
    rows = decontam.overlap_rows(odd_docs, bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in rows) == [(4, 9), (5, 9), (5, 9), (5, 9), (5, 9), (6, 9)]
    kept = decontam.drop_contaminated(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 6
    assert decontam.overlap_rows(no_docs, bench).collect() == []
    assert decontam.overlap_rows(odd_docs, bench.limit(0)).collect() == []
    assert decontam.drop_contaminated(odd_docs, bench.limit(0)).count() == odd_docs.count()


@pytest.mark.parametrize("n", range(decontam.LEAST, decontam.WINDOW + 1))
def test_masks_hit_every_tolerated_pattern(n):
    replaced = decontam.WINDOW - decontam.SAME if n == decontam.WINDOW else n // 5
    places = [
        {p + k for k, bit in enumerate(m) if bit == "1"} for m in decontam.MASKS[n] for p in range(n - len(m) + 1)
    ]
    assert all(any(at.isdisjoint(gone) for at in places) for gone in itertools.combinations(range(n), replaced))


def test_overlaps_by_the_law_alone(spark):
    """Every choice of replaced words in items of all lengths, with no masks in what is expected."""
    items = {n: " ".join(f"w{n}x{j}" for j in range(n)) for n in (5, 7, 8, 9, 12, 13, 15)}
    texts, want = [], set()
    for n, item in items.items():
        for gone in itertools.chain(*(itertools.combinations(range(n), k) for k in range(min(n, 4) + 1))):
            same = [j not in gone for j in range(n)]
            key = len(texts)
            texts.append((key, "before " + " ".join(w if s else "other" for w, s in zip(item.split(), same, strict=True)) + " behind"))
            if sum(same) * 5 >= n * 4 if n < 13 else any(sum(same[s : s + 13]) >= 10 for s in range(n - 12)):
                want.add((key, n, n, sum(same)))
    texts += [(-1, " ".join(items[15].split()[:10])), (-2, " ".join(items[15].split()[6:]))]  # ten words at the text's edge; nine
    want.add((-1, 15, 15, 10))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(sorted(items.items()), "item_id long, text string")
    assert {tuple(r) for r in decontam.overlap_rows(docs, bench).collect()} == want
