from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from calibra.llm import quality


def slow_score(net, text):
    """The score from the definition: every window, every chunk, no tables."""
    w, raw = net.weights, (text or "").encode()
    n = max(1, len(raw))
    data = np.frombuffer(raw + bytes(quality.WIDTH + 1), np.uint8)
    answers = np.array([
        np.einsum("ke,kef->f", w["embed"][data[i : i + quality.WIDTH]], w["filters"]) + w["bias"] for i in range(n)
    ])
    half = quality.CHUNK // 2
    starts = range(0, max(1, -(-n // half) - 1) * half, half)
    chunk = np.maximum([answers[s : s + quality.CHUNK].max(axis=0) for s in starts], 0)
    doc = np.concatenate([chunk.max(axis=0), chunk.mean(axis=0), chunk.min(axis=0)])
    hidden = np.maximum(doc @ w["dense"] + w["dense_bias"], 0)
    return 1 / (1 + np.exp(-(hidden @ w["out"] + w["out_bias"][0] + net.prior)))


def test_scores_follow_the_definition():
    net, draw = quality.ByteNet(prior=0.7), random.Random(1)
    texts = ["".join(draw.choice("ab c\né%") for _ in range(n)) for n in (0, 1, 5, 255, 256, 257, 511, 512, 513, 1400, 20000)]
    got = net.scores([t.encode() for t in texts] + [None], net.tables())
    assert np.allclose(got, [slow_score(net, t) for t in [*texts, None]], atol=1e-4)


def test_gradients():
    net, draw = quality.ByteNet(), random.Random(2)
    texts = ["".join(draw.choice("abc de") for _ in range(draw.choice([3, 90, 700]))) for _ in range(6)]
    pieces, y = [net.chunks(t.encode()) for t in texts], np.array([0, 1, 1, 0, 1, 0.0])

    def loss():
        p = net.scores([t.encode() for t in texts], net.tables())
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name, grad in net._gradients(pieces, y).items():
        at = tuple(np.unravel_index(np.abs(grad).argmax(), grad.shape))
        before = net.weights[name][at]
        values = []
        for step in (2e-3, -2e-3):
            net.weights[name][at] = before + step
            values.append(loss())
        net.weights[name][at] = before
        assert abs((values[0] - values[1]) / 4e-3 - grad[at]) < 0.05 * abs(grad[at]) + 1e-4, name


def test_held_out_accuracy(spark):
    draw = random.Random(4)
    rows = []
    for i in range(900):
        words = ["".join(draw.choice("etaoinshrdlu") for _ in range(draw.randint(2, 8))) for _ in range(draw.randint(5, 120))]
        good = i % 3 > 0
        rows.append((i, " ".join(words) if good else " ".join(w + draw.choice(["###", "&&&", "%%%"]) for w in words), int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = docs.select("doc_id", "quality", F.lit(0).alias("toxic"))
    out = quality.quality_rows(docs.select("doc_id", "text", F.lit("en").alias("lang")), labels).collect()
    truth = {i: q for i, _, q in rows}
    held = [r for r in out if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in out)


def test_held_out_labels_are_not_read(documents, spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (quality.train(documents, x) for x in (labels, turned))
    assert all((one.weights[k] == two.weights[k]).all() for k in one.weights) and one.prior == two.prior


def test_odd_rows(odd_docs, no_docs, spark):
    one_label = spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    none = one_label.limit(0)
    odd = spark.createDataFrame([(None, 1), (3, 1), (3, 0), (4, None), (5, 7), (1, 0), (8, 1)], "doc_id long, quality int")
    for labels, score in ((one_label, 1.0), (none, 0.5), (odd, None)):
        rows = quality.quality_rows(odd_docs, labels).collect()
        assert len(rows) == odd_docs.count()
        assert all(0 <= r["score"] <= 1 for r in rows)
        assert score is None or {r["score"] for r in rows} == {score}
    assert quality.quality_rows(no_docs, one_label).collect() == []
    kept = quality.keep_good(odd_docs.withColumn("own_score", F.lit(1)), quality.ByteNet(constant=0.4))
    assert kept.columns == [*odd_docs.columns, "own_score"] and kept.count() == odd_docs.count()


def test_score_is_the_same_alone_and_in_any_batch():
    net, draw = quality.ByteNet(), random.Random(9)
    texts = [bytes(draw.choice(b"abc de#%") for _ in range(n)) for n in (*range(58, 67), *range(252, 259), 512, 1024)]
    alone = [net.scores([t], net.tables())[0] for t in texts]
    for batch in (texts, texts[::-1]):
        got = dict(zip(batch, net.scores(batch, net.tables()), strict=True))
        assert np.allclose([got[t] for t in texts], alone, rtol=0, atol=1e-6)


def test_labels_of_unknown_documents_do_not_count(spark):
    draw = random.Random(11)
    rows = [(i, " ".join(draw.choice(["good", "fine", "text"] if i % 2 else ["##", "!!", "%%"]) for _ in range(20))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, i % 2) for i in range(200)]
    one = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    two = quality.train(docs, spark.createDataFrame(labels + [(10_000 + i, 0) for i in range(4000)], "doc_id long, quality int"))
    assert one.prior == two.prior and all((one.weights[k] == two.weights[k]).all() for k in one.weights)
