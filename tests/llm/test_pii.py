from __future__ import annotations

import hashlib

from calibra.llm import pii
from tests.llm.brute import PII, personal


def check(docs, texts):
    rows = {r["doc_id"]: r for r in pii.pii_rows(docs).collect()}
    assert set(rows) == set(texts)
    for key, text in texts.items():
        spans, r = personal(text), rows[key]
        said = [f"{list(PII)[k]}:{a}:{b}" for a, k, b in spans]
        assert r["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest(), (key, said, r)
        assert [r[f"n_{k}"] for k in PII] == [sum(s[1] == n for s in spans) for n in range(4)]
        assert set(said) <= set(r["spans"].split(","))
    return rows


def test_documents(documents, texts):
    check(documents, texts)


def test_edges(spark):
    texts = [
        "a@b.c_d@e.f x@@y.z a@b@c.d .a@-.- q@w.e.r..t@y.u %@1.2",
        "1.2.3.4.5.6.7.8 001.002.003.0255 256.1.1.1 1.2.3 9999999999999999999.1.1.1 10.0.0.1.",
        "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 4111111111111112 411111111111111 1 2 3 4 5 6 7 8 9 0 1 2 3 7",
        "+1 (706) 555-3138 +1 706 +123456789012345 +1234567890123456 ++49 30 123456789 +49.30.1234567- (+1)2345678901",
        "é日本 😀 a@b.cd 😀 +49 30 123456789",
        "1.2.3.4 " * 700,
        "a" * 30_000 + "@" + "b." * 9000 + "c",
        "7 " * 20_000 + "+" + "1" * 20_000 + " " + "9" * 30_000 + "." * 9000,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(docs, dict(enumerate(texts)))


def test_contexts_find_more(spark):
    rows = [(i, f"please call phone: +49 30 {1000000 + i * 7919} now") for i in range(12)]
    rows += [(100 + i, f"please call phone: (030-{5550000 + i * 13}), or come in year 2024 with 20241224") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.pii_rows(docs).collect()}
    for i in (100, 101, 102):
        text, (kind, a, b) = rows[12 + i - 100][1], out[i]["spans"].split(":")
        assert kind == "phone" and text[int(a) : int(b)] == f"030-{5550000 + (i - 100) * 13}"
        assert out[i]["n_phone"] == 0
    assert all(out[i]["spans"].count(":") == 2 for i in range(12))


def test_odd_rows(odd_docs, no_docs):
    rows = pii.pii_rows(odd_docs).collect()
    assert len(rows) == odd_docs.count() and {r["spans"] for r in rows} == {""}
    assert pii.pii_rows(no_docs).collect() == []
