"""Quality of whole texts by a small byte-level convolutional network.

Every byte has a learned embedding; learned filters look at six bytes at a
time and at every position of the text. The answers are max-pooled over chunks
of 512 positions that overlap by half and cover the whole text, and the
chunks' answers are combined (largest, mean and least of each filter) into one
probability by two dense layers. Everything is numpy. For scoring, the filters
are folded into one table per byte pair, so a position costs three lookups per
filter.

Training reads a bounded sample of labelled rows, ``SAMPLE`` of each label in
the order of a hash, and at most ``TRAIN_CHUNKS`` chunks spread over each text.
The sample is balanced; the share of the labels among all training rows, which
is counted, goes back into the probability. Scoring reads every byte.

Defined results: a null or empty text is scored as one position of zero bytes;
labels other than 0 and 1 and labels of unknown documents teach nothing;
repeated labels of a document are averaged; without rows of both labels the
score is the share of label 1, or one half when there is no label at all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.llm.common import fresh_names, materialize

SAMPLE = 1500  # documents of each label
TRAIN_CHUNKS = 8
WIDTH, EMBED, FILTERS, HIDDEN = 6, 8, 16, 16
STEP = 64  # positions of the smallest block
HALF = 4  # blocks of half a chunk
CHUNK = 2 * HALF * STEP
RUN = 1 << 14  # positions that are worked on at once
SLICE_BYTES = 2 << 20


@dataclass
class ByteNet:
    """The weights, how to score texts and how to learn from them."""

    seed: int = 5
    prior: float = 0.0  # log odds of label 1 against a balanced sample
    constant: float | None = None
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        draw = np.random.default_rng(self.seed)
        self.weights = {
            "embed": draw.normal(0, 0.5, (256, EMBED)),
            "filters": draw.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH, EMBED, FILTERS)),
            "bias": np.zeros(FILTERS),
            "dense": draw.normal(0, (3 * FILTERS) ** -0.5, (3 * FILTERS, HIDDEN)),
            "dense_bias": np.zeros(HIDDEN),
            "out": draw.normal(0, HIDDEN**-0.5, HIDDEN),
            "out_bias": np.zeros(1),
        }

    # scoring -------------------------------------------------------------

    def tables(self) -> list[np.ndarray]:
        """For each pair of neighbouring window places the filters' answers to all byte pairs."""
        per_byte = np.einsum("be,kef->kbf", self.weights["embed"], self.weights["filters"])
        pairs = [(per_byte[k][:, None, :] + per_byte[k + 1][None, :, :]).reshape(-1, FILTERS) for k in range(0, WIDTH, 2)]
        pairs[0] = pairs[0] + self.weights["bias"]
        return [p.astype(np.float32) for p in pairs]

    def scores(self, texts: Sequence[bytes | None], tables: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        if not len(texts):
            return np.zeros(0)
        sizes = np.array([max(1, len(t or b"")) for t in texts])
        blocks = -(-(sizes + WIDTH - 1) // STEP)  # the last windows read zeros of the text's own
        first = np.concatenate([[0], np.cumsum(blocks)])
        data = np.zeros(first[-1] * STEP + WIDTH, np.uint16)
        dead = np.ones(first[-1] * STEP, bool)  # padding behind a text
        for t, at, n in zip(texts, first * STEP, sizes, strict=False):
            if t:
                data[at : at + n] = np.frombuffer(t, np.uint8)
            dead[at : at + n] = False
        pooled = np.empty((first[-1], FILTERS), np.float32)
        pair = data[:-1] * np.uint16(256) + data[1:]
        for lo in range(0, len(dead), RUN):
            hi = min(lo + RUN, len(dead))
            answer = tables[0].take(pair[lo:hi], axis=0)
            answer += tables[1].take(pair[lo + 2 : hi + 2], axis=0)
            answer += tables[2].take(pair[lo + 4 : hi + 4], axis=0)
            answer[dead[lo:hi]] = -np.inf
            pooled[lo // STEP : hi // STEP] = answer.reshape(-1, STEP, FILTERS).max(axis=1)
        halves = -(-sizes // (HALF * STEP))
        half_first = np.concatenate([[0], np.cumsum(halves)])
        within = np.arange(half_first[-1]) - np.repeat(half_first[:-1], halves)
        half = np.maximum.reduceat(pooled, np.repeat(first[:-1], halves) + within * HALF, axis=0)
        last = np.zeros(len(half), bool)
        last[half_first[1:] - 1] = True
        chunk = np.where(last[:, None], half, np.maximum(half, np.roll(half, -1, axis=0)))
        chunk = np.maximum(chunk[~last | (np.repeat(halves, halves) == 1)], 0)
        return self._probability(chunk, np.maximum(1, halves - 1))

    def _probability(self, chunk: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = self.weights
        hidden = np.maximum(self._combine(chunk, counts) @ w["dense"] + w["dense_bias"], 0)
        logit = hidden @ w["out"] + w["out_bias"] + self.prior
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))

    @staticmethod
    def _combine(chunk: np.ndarray, counts: np.ndarray) -> np.ndarray:
        at = np.concatenate([[0], np.cumsum(counts)[:-1]])
        mean = np.add.reduceat(chunk, at, axis=0, dtype=np.float64) / counts[:, None]
        return np.concatenate([np.maximum.reduceat(chunk, at, axis=0), mean, np.minimum.reduceat(chunk, at, axis=0)], axis=1)

    # learning ------------------------------------------------------------

    @staticmethod
    def chunks(raw: bytes) -> list[np.ndarray]:
        """At most TRAIN_CHUNKS chunks spread evenly over the text, each with the window's overhang."""
        starts = np.arange(0, max(1, len(raw) - CHUNK // 2), CHUNK // 2)
        if len(starts) > TRAIN_CHUNKS:
            starts = starts[np.linspace(0, len(starts) - 1, TRAIN_CHUNKS).round().astype(int)]
        data = np.frombuffer(raw + bytes(WIDTH), np.uint8)
        return [data[s : min(s + CHUNK, max(1, len(raw))) + WIDTH - 1] for s in starts]

    def fit(self, texts: Sequence[bytes | None], labels: Sequence[float], epochs: int = 14, batch: int = 48) -> None:
        """Adam on the log loss; the gradient of a maximum goes to the position that holds it."""
        draw = np.random.default_rng(self.seed)
        pieces = [self.chunks(t or b"") for t in texts]
        y = np.asarray(labels, float)
        steps = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.weights.items()}
        turn, turns = 0, epochs * -(-len(y) // batch)
        for _ in range(epochs):
            order = draw.permutation(len(y))
            for lo in range(0, len(order), batch):
                turn += 1
                some = order[lo : lo + batch]
                grads = self._gradients([pieces[i] for i in some], y[some])
                rate = 0.01 * (1 - (turn - 1) / turns)
                for k, g in grads.items():
                    m, v = steps[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.weights[k] -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)

    def _gradients(self, pieces: list[list[np.ndarray]], y: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        counts = np.array([len(p) for p in pieces])
        flat = [c for p in pieces for c in p]
        tables = np.einsum("be,kef->kbf", w["embed"], w["filters"]).astype(np.float32)
        spots = np.empty((len(flat), FILTERS), np.int64)  # where each filter answers most
        top = np.empty((len(flat), FILTERS))
        for i, c in enumerate(flat):
            n = len(c) - WIDTH + 1
            answer = tables[0].take(c[:n], axis=0)
            for k in range(1, WIDTH):
                answer += tables[k].take(c[k : k + n], axis=0)
            spots[i] = answer.argmax(axis=0)
            top[i] = answer.max(axis=0)
        top += w["bias"]
        chunk = np.maximum(top, 0)
        doc = self._combine(chunk, counts)
        raw = doc @ w["dense"] + w["dense_bias"]
        hidden = np.maximum(raw, 0)
        p = 1 / (1 + np.exp(-np.clip(hidden @ w["out"] + w["out_bias"], -40, 40)))
        d_logit = (p - y) / len(y)
        d_raw = np.outer(d_logit, w["out"]) * (raw > 0)
        d_doc = d_raw @ w["dense"].T
        of = np.repeat(np.arange(len(counts)), counts)
        d_chunk = d_doc[of, FILTERS : 2 * FILTERS] / counts[of, None]
        for block, best in ((0, doc[:, :FILTERS]), (2 * FILTERS, doc[:, 2 * FILTERS :])):
            hit = chunk == best[of]
            ties = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0, dtype=float)
            d_chunk += np.where(hit, d_doc[of, block : block + FILTERS] / ties[of], 0)
        d_top = d_chunk * (top > 0)
        seen = np.stack([np.stack([c[s + k] for k in range(WIDTH)]) for c, s in zip(flat, spots, strict=True)])
        d_filters, d_embed = np.empty_like(w["filters"]), np.zeros_like(w["embed"])
        for k in range(WIDTH):
            near = w["embed"][seen[:, k]]  # chunk, filter, embedding
            d_filters[k] = np.einsum("cf,cfe->ef", d_top, near)
            np.add.at(d_embed, seen[:, k], d_top[:, :, None] * w["filters"][k].T[None])
        return {
            "embed": d_embed,
            "filters": d_filters,
            "bias": d_top.sum(axis=0),
            "dense": doc.T @ d_raw,
            "dense_bias": d_raw.sum(axis=0),
            "out": hidden.T @ d_logit,
            "out_bias": d_logit.sum(keepdims=True),
        }


def held_out(key: str = "doc_id", folds: int = 5) -> Column:
    """Whether a document's labels are kept from training."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality") -> ByteNet:
    """A network fitted on a bounded sample of the labelled rows outside the held-out fold."""
    known = labels.where(~held_out(key) & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key"))
    known = known.agg(F.round(F.avg(label)).cast("int").alias("label"))
    ids = docs.select(F.col(key).alias("key"))  # only labels of documents that are there count and teach
    known = materialize(known.join(ids, "key", "left_semi"), "quality-labels")
    share = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    net = ByteNet()
    if len(share) < 2:
        net.constant = float(next(iter(share))) if share else 0.5
        return net
    known = known.withColumn("turn", F.xxhash64("key", F.lit(net.seed)))
    sample = [known.where(F.col("label") == v).orderBy("turn", "key").limit(SAMPLE) for v in (0, 1)]
    # at most 2 * SAMPLE short rows, so the broadcast is bounded; long texts are cut to the chunks on the workers
    chosen = F.broadcast(sample[0].unionAll(sample[1]))
    picked = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("raw")).join(chosen, "key")
    limit = TRAIN_CHUNKS * CHUNK

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [b or b"" for b in batch.column("raw").to_pylist()]
            short = [r if len(r) <= 2 * limit else b"".join(c.tobytes() for c in ByteNet.chunks(r)) for r in raws]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").cast(pa.string()), pa.array(short, pa.binary()), batch.column("label")],
                names=["key", "raw", "label"],
            )

    one_each = picked.mapInArrow(cut, "key string, raw binary, label int").groupBy("key").agg(F.min("raw"), F.min("label"))
    rows = sorted(one_each.collect())
    if len({r[2] for r in rows}) < 2:
        net.constant = share.get(1, 0) / sum(share.values())
        return net
    net.fit([r[1] for r in rows], [r[2] for r in rows])
    n1 = sum(r[2] for r in rows)
    net.prior = float(np.log(share[1] / share[0]) - np.log(n1 / (len(rows) - n1)))
    return net


def score(docs: DataFrame, net: ByteNet, *, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in a further column."""
    shape = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, `{name}` double"
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables()
        for batch in batches:
            column, lo, held, found = batch.column(at), 0, 0, [np.zeros(0)]
            for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
                held += n
                if held >= SLICE_BYTES or i + 1 == len(column):
                    part = column.slice(lo, i + 1 - lo).cast(pa.binary()).to_pylist()
                    found.append(net.scores(part, tables))
                    lo, held = i + 1, 0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(found))], names=[*batch.schema.names, name]
            )

    return docs.mapInArrow(run, shape)


def quality_rows(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """The score of every document, with the fold and the decision."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, net: ByteNet, *, text: str = "text", cut: float = 0.3) -> DataFrame:
    """The documents that the network does not reject."""
    name = fresh_names(docs, "score")["score"]
    return score(docs, net, text=text, name=name).where(F.col(name) >= cut).drop(name)
