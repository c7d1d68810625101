from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.llm import language


def slow(net, text):
    """The probabilities from the definition: every window, every place, no tables."""
    raw, w = text.encode(), net.weights
    total = np.zeros(len(net.languages))
    for lo in range(0, len(raw), language.WINDOW):
        live = min(language.WINDOW, len(raw) - lo)
        data = np.frombuffer((raw[lo : lo + language.WINDOW + language.OVER] + bytes(300))[: language.WINDOW + language.OVER], np.uint8)
        top = []
        for width in language.WIDTHS:
            answers = [np.einsum("ke,kef->f", w["embed"][data[i : i + width]], w[f"filters{width}"]) for i in range(live)]
            top.append(np.max(answers, axis=0))
        total += live * (np.maximum(np.concatenate(top) + w["bias"], 0) @ w["dense"] + w["dense_bias"])
    e = np.exp(total / len(raw) - (total / len(raw)).max())
    return e / e.sum()


def test_scores_follow_the_definition():
    net, draw = language.LanguageNet(["a", "b", "c"]), random.Random(1)
    net.weights["bias"] += 0.1
    texts = ["".join(draw.choice("ab c\né%") for _ in range(n)) for n in (1, 2, 3, 250, 253, 254, 255, 256, 257, 511, 512, 1400, 9000)]
    got = net.probabilities([t.encode() for t in texts], net.tables())
    assert np.allclose(got, [slow(net, t) for t in texts], atol=1e-5)
    alone = np.concatenate([net.probabilities([t.encode()], net.tables()) for t in texts])
    assert np.allclose(got, alone, atol=1e-7)  # neighbours in a batch do not matter


def test_gradients():
    net, draw = language.LanguageNet(["a", "b", "c"]), np.random.default_rng(2)
    windows = draw.integers(97, 105, (6, language.WINDOW + language.OVER)).astype(np.uint8)
    live, labels = np.array([256, 256, 9, 100, 1, 255]), np.array([0, 1, 2, 0, 1, 2])

    def loss():
        dead = np.arange(language.WINDOW)[None] >= live[:, None]
        tops = []
        for width, table in zip(language.WIDTHS, net.per_byte(), strict=True):
            answer = sum(table[k][windows[:, k : k + language.WINDOW]] for k in range(width))
            answer[dead] = -np.inf
            tops.append(answer.max(axis=1))
        pooled = np.maximum(np.concatenate(tops, axis=1) + net.weights["bias"], 0)
        p = language.softmax(pooled @ net.weights["dense"] + net.weights["dense_bias"])
        return -np.log(p[np.arange(6), labels]).mean()

    grads = net.gradients(windows, live, labels)
    for name, w in net.weights.items():
        for at in [tuple(draw.integers(0, s) for s in w.shape) for _ in range(6)] + ([(98, 1), (100, 3)] if name == "embed" else []):
            was = w[at]
            w[at] = was + 1e-5
            up = loss()
            w[at] = was - 1e-5
            down = loss()
            w[at] = was
            assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-4, (name, at)


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r["doc_id"]: (r["lang"], r["text"]) for r in docs.collect()}
    rows = language.language_rows(docs).collect()
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in {"de", "en", "es", "fr", "und"} for r in rows)
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in lang[r["doc_id"]][1] or "")) for r in rows)
    judged = [r["lang_pred"] == lang[r["doc_id"]][0] for r in rows if r["held_out"] and lang[r["doc_id"]][0] and r["lang_pred"] != "und"]
    assert len(judged) > 150 and np.mean(judged) > 0.95


def test_held_out_labels_teach_nothing(spark):
    """Wrong labels in the held-out fold, and no labels elsewhere, change no prediction."""
    draw = random.Random(4)
    text = lambda i: " ".join(draw.choice(["the", "and", "this"] if i % 2 else ["der", "und", "dies"]) for _ in range(30))
    rows = [(i, text(i), "en" if i % 2 else "de") for i in range(200)]
    wrong = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else g) for i, t, g in rows] + [(900 + i, "1 2 3", None) for i in range(5)]
    shape = "doc_id long, text string, lang string"
    one = {r["doc_id"]: r for r in language.language_rows(spark.createDataFrame(rows, shape)).collect()}
    two = {r["doc_id"]: r for r in language.language_rows(spark.createDataFrame(wrong, shape).repartition(3)).collect()}
    assert all(one[i] == two[i] for i in one)
    assert all(one[i]["lang_pred"] == ("en" if i % 2 else "de") for i in one)
    assert all(two[900 + i]["lang_pred"] == "und" and two[900 + i]["score"] == 0 for i in range(5))


def test_very_long_text(spark):
    draw = random.Random(8)
    rows = [(i, " ".join(draw.choice(["the", "and", "of"] if i % 2 else ["le", "et", "que"]) for _ in range(40)), "en" if i % 2 else "fr") for i in range(80)]
    rows.append((81, "1 " * 400_000 + rows[0][1] * 3000, None))
    got = {r["doc_id"]: r for r in language.language_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[81]["lang_pred"] in {"en", "fr"} and len(got) == 81


@pytest.mark.parametrize("langs", [0, 1])
def test_few_languages(spark, langs):
    rows = [(i, "some text" if i else "12", "en" if langs else None) for i in range(30)]
    got = language.language_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {(r["lang_pred"], r["score"]) for r in got if r["doc_id"]} == ({("en", 1.0)} if langs else {("und", 0.0)})


def test_odd_rows(spark, odd_docs, no_docs):
    clash = odd_docs.withColumn("own_letter", F.lit(1)).withColumn("lang_pred", F.lit("x"))
    got = language.language_rows(clash).collect()
    assert len(got) == odd_docs.count()
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (0, 1, 2)] == ["und"] * 3 and by[4]["lang_pred"] == "en"
    assert by[None]["held_out"] is False and by[8]["lang_pred"] == "en"
    assert language.language_rows(no_docs).collect() == []
