from __future__ import annotations

import zlib

import pytest

from calibra.llm import sharding


def check(rows, shards, tolerance):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    for rs in by.values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
    sizes = [sum(r["size"] for r in by.get(s, [])) for s in range(shards)]
    mean = sum(sizes) / shards
    assert max(abs(s - mean) for s in sizes) <= tolerance
    assert set(by) <= set(range(shards))


def test_documents(documents, texts):
    rows = sharding.shard_rows(documents, 24).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
    check(rows, 24, 2 * max(r["size"] for r in rows))
    again = sharding.shard_rows(documents.repartition(5), 24).collect()
    assert len(again) == len(rows)


def test_hot_group_is_split(spark):
    rows = [(i, "the same text again and again", "en", "s") for i in range(900)] + [(900 + i, f"text {i}", "en", "s") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = sharding.shard_rows(docs, 7).collect()
    check(got, 7, 80)


def test_copies_stay_together(spark):
    rows = [(i, f"document number {i // 2} with a text of its own " * 5, f"l{i % 2}", f"s{i % 5}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    shard = {r["doc_id"]: r["shard"] for r in sharding.shard_rows(docs, 4).collect()}
    assert sum(shard[i] != shard[i + 1] for i in range(0, 400, 2)) <= 3  # a cut may fall inside a group


@pytest.mark.parametrize("shards", [1, 2, 5])
def test_odd_rows(odd_docs, shards):
    rows = sharding.shard_rows(odd_docs, shards).collect()
    assert len(rows) == odd_docs.count()
    check(rows, shards, 15_000)
    assert {r["size"] for r in rows if r["doc_id"] == 0} == {8}


def test_rows_alike(spark):
    docs = spark.createDataFrame([(1, "x" * 92, "en", "s")] * 50, "doc_id long, text string, lang string, source string")
    check(sharding.shard_rows(docs, 5).collect(), 5, 100)


def test_empty(no_docs):
    assert sharding.shard_rows(no_docs).collect() == []


def test_target_bytes(documents):
    out = sharding.kd_shards(documents, target_bytes=100_000).collect()
    total = sum(r["size"] for r in out)
    assert len({r["shard"] for r in out}) == -(-total // 100_000)
    with pytest.raises(ValueError, match="shards or target"):
        sharding.kd_shards(documents)
