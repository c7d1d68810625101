"""The language of whole texts by a byte-level convolutional network.

Every byte has a learned embedding; learned filters of several widths look at
two, three and four bytes at a time. A text is cut into windows of ``WINDOW``
bytes that cover it whole (each reads on into the next by a filter's width, so
nothing at a border is missed); in a window every filter keeps its largest
answer, and a softmax layer turns these into a score for each language. The
windows' logits are averaged by their length into one probability. Everything
is numpy; for scoring, filters are folded into tables per byte pair, and windows
of many texts are worked on together.

Training takes windows from all over the labelled texts, at most ``SAMPLE`` of
each language in the order of a hash, drawn where the texts lie. Windows are
shortened at random while learning, so that short texts are known too.

Defined results: a text that is null or has no letter is ``und`` with score 0,
and so is every text when no language was learned; a document whose id is null
is not held out and teaches nothing; every value that is not null is a
language; repeated rows are scored alike; an empty table
gives no rows. Languages are sorted, and ties go to the first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from calibra.llm.common import fresh_names

SAMPLE = 1000  # windows of each language
WINDOW = 256  # bytes
WIDTHS, EMBED, FILTERS = (2, 3, 4), 8, 16
OVER = max(WIDTHS) - 1
BATCH = 64  # windows worked on at once
SLICE_BYTES = 2 << 20
UNKNOWN = "und"


def cut(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts with their overhang, their live bytes, and the number of windows of each text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = -(-sizes // WINDOW)
    room = -(-(sizes + OVER) // WINDOW) * WINDOW
    at = np.cumsum(room) - room
    data = np.zeros(int(room.sum()) + WINDOW + OVER, np.uint8)
    for t, lo in zip(texts, at.tolist(), strict=True):
        data[lo : lo + len(t)] = np.frombuffer(t, np.uint8)
    first = np.cumsum(counts) - counts
    no = np.arange(int(counts.sum())) - np.repeat(first, counts)
    starts = np.repeat(at, counts) + no * WINDOW
    windows = np.lib.stride_tricks.sliding_window_view(data, WINDOW + OVER)[starts]
    return windows, np.minimum(WINDOW, np.repeat(sizes, counts) - no * WINDOW), counts


@dataclass
class LanguageNet:
    """The weights, how to score windows and how to learn from them."""

    languages: list[str]
    seed: int = 13
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        draw = np.random.default_rng(self.seed)
        self.weights = {"embed": draw.normal(0, 0.5, (256, EMBED))}
        for w in WIDTHS:
            self.weights[f"filters{w}"] = draw.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS))
        self.weights["bias"] = np.zeros(FILTERS * len(WIDTHS))
        self.weights["dense"] = draw.normal(0, 0.1, (FILTERS * len(WIDTHS), len(self.languages)))
        self.weights["dense_bias"] = np.zeros(len(self.languages))

    def per_byte(self) -> list[np.ndarray]:
        """For each width and place in a filter the answers to every byte."""
        return [np.einsum("be,kef->kbf", self.weights["embed"], self.weights[f"filters{w}"]) for w in WIDTHS]

    # scoring -------------------------------------------------------------

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Answers of all filters to the first byte pair, of width 3 to the third byte, of width 4 to the second pair."""
        two, three, four = self.per_byte()
        pair = lambda t, k: (t[k][:, None, :] + t[k + 1][None, :, :]).reshape(-1, FILTERS)
        first = np.concatenate([pair(two, 0), pair(three, 0), pair(four, 0)], axis=1) + self.weights["bias"]
        return first.astype(np.float32), three[2].astype(np.float32), pair(four, 2).astype(np.float32)

    def logits(self, windows: np.ndarray, live: np.ndarray, tables: tuple[np.ndarray, ...]) -> np.ndarray:
        """The languages' scores of every window."""
        top = np.empty((len(windows), FILTERS * len(WIDTHS)), np.float32)
        for lo in range(0, len(windows), BATCH):
            some = windows[lo : lo + BATCH].astype(np.int32)
            pair = some[:, :-1] * 256 + some[:, 1:]
            answer = tables[0].take(pair[:, :WINDOW], axis=0)
            answer[:, :, FILTERS : 2 * FILTERS] += tables[1].take(some[:, 2 : WINDOW + 2], axis=0)
            answer[:, :, 2 * FILTERS :] += tables[2].take(pair[:, 2 : WINDOW + 2], axis=0)
            for i in np.flatnonzero(live[lo : lo + BATCH] < WINDOW).tolist():
                answer[i, live[lo + i] :] = -np.inf
            top[lo : lo + BATCH] = answer.max(axis=1)
        return np.maximum(top, 0) @ self.weights["dense"] + self.weights["dense_bias"]

    def probabilities(self, texts: Sequence[bytes], tables: tuple[np.ndarray, ...]) -> np.ndarray:
        """A row for each text (none of them empty), a column for each language."""
        if not len(texts):
            return np.zeros((0, len(self.languages)))
        windows, live, counts = cut(texts)
        logits = self.logits(windows, live, tables) * live[:, None]
        at = np.cumsum(counts) - counts
        mean = np.add.reduceat(logits, at, axis=0) / np.add.reduceat(live, at)[:, None]
        return softmax(mean)

    # learning ------------------------------------------------------------

    def fit(self, windows: np.ndarray, live: np.ndarray, labels: np.ndarray, epochs: int = 6) -> None:
        """Adam on the log loss; half of the windows are cut to a random length at every turn."""
        draw = np.random.default_rng(self.seed)
        steps = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.weights.items()}
        turn, turns = 0, epochs * -(-len(labels) // BATCH)
        for _ in range(epochs):
            order = draw.permutation(len(labels))
            short = np.where(draw.random(len(labels)) < 0.5, draw.integers(np.minimum(4, live), live, endpoint=True), live)
            for lo in range(0, len(order), BATCH):
                turn += 1
                some = order[lo : lo + BATCH]
                rate = 0.01 * (1 - (turn - 1) / turns)
                for k, g in self.gradients(windows[some], short[some], labels[some]).items():
                    m, v = steps[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.weights[k] -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)

    def gradients(self, windows: np.ndarray, live: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss; the gradient of a maximum goes to the place that holds it."""
        w, n = self.weights, len(labels)
        dead = np.arange(WINDOW)[None, :] >= live[:, None]
        tops, spots = [], []
        for width, table in zip(WIDTHS, self.per_byte(), strict=True):
            table = table.astype(np.float32)
            answer = table[0].take(windows[:, :WINDOW], axis=0)
            for k in range(1, width):
                answer += table[k].take(windows[:, k : k + WINDOW], axis=0)
            answer[dead] = -np.inf
            at = answer.argmax(axis=1)
            spots.append(at)
            tops.append(np.take_along_axis(answer, at[:, None, :], axis=1)[:, 0])
        top = np.concatenate(tops, axis=1) + w["bias"]
        pooled = np.maximum(top, 0)
        error = softmax(pooled @ w["dense"] + w["dense_bias"])
        error[np.arange(n), labels] -= 1
        error /= n
        d_top = (error @ w["dense"].T) * (top > 0)
        out = {"bias": d_top.sum(axis=0), "dense": pooled.T @ error, "dense_bias": error.sum(axis=0), "embed": np.zeros_like(w["embed"])}
        rows = np.arange(n)[:, None]
        for i, width in enumerate(WIDTHS):
            part, filters = d_top[:, i * FILTERS : (i + 1) * FILTERS], w[f"filters{width}"]
            grad = np.empty_like(filters)
            for k in range(width):
                seen = windows[rows, spots[i] + k]  # window, filter
                grad[k] = np.einsum("nf,nfe->ef", part, w["embed"][seen])
                np.add.at(out["embed"], seen, part[:, :, None] * filters[k].T[None])
            out[f"filters{width}"] = grad
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fold_of(key: str = "doc_id", folds: int = 4) -> Column:
    """The fold of a document, null without an id."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def train(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", held: int = 2) -> LanguageNet:
    """A network fitted on a bounded sample of windows of the documents outside the held-out fold."""
    known = docs.where((fold_of(key) != held) & F.col(lang).isNotNull()).select(
        F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("binary").alias("raw")
    )
    known = known.where(F.octet_length("raw") > 0)
    totals = known.groupBy("lang").agg(F.sum(F.ceil(F.octet_length("raw") / WINDOW)).alias("n")).orderBy("lang").collect()
    net = LanguageNet([r["lang"] for r in totals])
    if len(totals) < 2:
        return net
    rates = {r["lang"]: min(1.0, 2 * SAMPLE / r["n"]) for r in totals}  # about twice as many as are kept

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[str, int, bytes, int]] = []
            for seed, name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                n = -(-len(raw.as_buffer()) // WINDOW)
                value = mixed(np.uint64(seed & (2**64 - 1)) + np.arange(n, dtype=np.uint64))
                picked = np.flatnonzero(value < np.uint64(int(rates[name] * (2**63))))
                if len(picked):
                    windows, live, _ = cut([raw.as_py()])
                    found += [(name, int(value[i]), windows[i].tobytes(), int(live[i])) for i in picked.tolist()]
            columns = list(zip(*found, strict=True)) or [[]] * 4
            types = (pa.string(), pa.int64(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["lang", "turn", "raw", "live"])

    seeded = known.select(F.xxhash64("key", F.lit(net.seed)), "lang", "raw")
    drawn = seeded.mapInArrow(draw, "lang string, turn bigint, raw binary, live int")
    order = W.partitionBy("lang").orderBy("turn", "raw", "live")
    sample = drawn.withColumn("no", F.row_number().over(order)).where(F.col("no") <= SAMPLE).drop("no")
    rows = sorted((r["lang"], r["turn"], bytes(r["raw"]), r["live"]) for r in sample.collect())
    place = {name: i for i, name in enumerate(net.languages)}
    windows = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), WINDOW + OVER)
    net.fit(windows, np.array([r[3] for r in rows]), np.array([place[r[0]] for r in rows]))
    return net


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers below 2**63 that look random, the same for the same input."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(1)


def predict(docs: DataFrame, net: LanguageNet, *, text: str = "text", name: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the language and its probability in further columns."""
    letter = fresh_names(docs, "letter")["letter"]
    asked = docs.withColumn(letter, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    shape = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, `{name}` string, `{score}` double"
    columns = docs.columns
    at = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables()
        for batch in batches:
            languages = np.full(batch.num_rows, -1)
            scores = np.zeros(batch.num_rows)
            known = np.flatnonzero(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)) if net.languages else []
            column, some, held = batch.column(at), [], 0
            sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy()
            for no, i in enumerate(known):
                some.append(int(i))
                held += int(sizes[i])
                if held >= SLICE_BYTES or no + 1 == len(known):
                    chances = net.probabilities(column.take(pa.array(some)).cast(pa.binary()).to_pylist(), tables)
                    languages[some], scores[some] = chances.argmax(axis=1), chances.max(axis=1)
                    some, held = [], 0
            names = pa.array([*net.languages, UNKNOWN], pa.string()).take(pa.array(np.where(languages < 0, len(net.languages), languages)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], names, pa.array(scores)], names=[*columns, name, score])

    return asked.mapInArrow(run, shape)


def language_rows(docs: DataFrame) -> DataFrame:
    """The language of every document, and whether it was held out from learning."""
    found = predict(docs.select("doc_id", "text"), train(docs))
    held = F.coalesce(fold_of() == 2, F.lit(False)).alias("held_out")
    return found.select("doc_id", held, "lang_pred", "score")
