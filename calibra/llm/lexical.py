"""Ranked lexical search with range-maximum tables over posting lists.

The documents are indexed in shards of at most ``SHARD_DOCS`` documents and
``SHARD_POSTINGS`` postings, as they are read: no shuffle. A shard holds, for
every term of the items, the list of its documents in ascending order, and the
impact of each posting, which is the part of the score that does not depend on
the item. A sparse table tells the place of the largest impact in any run of a
list by two lookups.

An item is searched best first. An interval of documents is bounded by the sum
over the item's terms of weight times largest impact in the interval. The
intervals with the largest bounds are split at the document of their largest
single share: it is scored exactly, and the two rests get bounds of their own.
The search of a shard ends when no bound reaches the k-th best score found so
far in the task; an interval that could only tie goes when all its ids are
larger. The best of all tasks are merged.

The score of a document is the sum over the item's terms, repeats included, of
``w * ((1000000000 * tf) div (1000 * tf + 8 * m))`` with
``w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))`` and
``m = 25 + ((75 * n * N) div L)``; N counts the documents with a term, L their
terms, df the documents with the term, tf and n its occurrences and all terms
in the document.

Defined results: terms are runs of ASCII letters and digits and of all other
characters beyond ASCII, with A to Z in lower case; a null or empty text has
none, is not counted and is never found; an item without terms, or whose terms
are nowhere, has no rows; equal scores go by ascending id, null ids last; rows
alike are documents of their own, and so are items with equal ids; an empty
table gives no rows. Whole texts are read, however long. Items are taken in
blocks of ``ITEM_BYTES`` of text, since their terms travel to every task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from calibra.llm.common import materialize

SHARD_DOCS, SHARD_POSTINGS = 16_384, 1 << 19
ITEM_BYTES = 8 << 20  # text of the items that are searched at once
SPLITS = 64  # intervals that are split at once

_TERM = bytes(b for b in range(256) if b >= 0x80 or chr(b).isalnum())
#: Bytes that belong to no term become spaces, A to Z become small.
_FOLD = bytes((b | 0x20 if 0x41 <= b <= 0x5A else b) if b in _TERM else 0x20 for b in range(256))

INDEX = "n_docs int, n_terms bigint, terms array<int>, counts array<int>, keys binary, nulls binary, sizes binary, docs binary, tfs binary"
_SHAPE = pa.schema(
    [("n_docs", pa.int32()), ("n_terms", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))]
    + [(n, pa.binary()) for n in ("keys", "nulls", "sizes", "docs", "tfs")]
)


def terms_of(raw: bytes | None) -> list[bytes]:
    """The terms of a text in order, as bytes."""
    return raw.translate(_FOLD).split() if raw else []


class ShardBuilder:
    """Collects documents with their postings until a shard is full."""

    def __init__(self, places: dict[bytes, int]):
        self.places = places
        self._clear()

    def _clear(self) -> None:
        self.keys: list[int | None] = []
        self.sizes: list[int] = []
        self.post_terms: list[int] = []
        self.tfs: list[int] = []
        self.of: list[int] = []

    def add(self, key: int | None, raw: bytes | None) -> None:
        found = terms_of(raw)
        if not found:
            return
        at, counts = len(self.keys), Counter(found)
        self.keys.append(key)
        self.sizes.append(len(found))
        for term in counts.keys() & self.places.keys():
            self.post_terms.append(self.places[term])
            self.tfs.append(counts[term])
            self.of.append(at)

    @property
    def full(self) -> bool:
        return len(self.keys) >= SHARD_DOCS or len(self.tfs) >= SHARD_POSTINGS

    def row(self) -> pa.RecordBatch:
        """The shard as one row: documents by ascending key, postings by term and document."""
        nulls = np.array([k is None for k in self.keys], np.uint8)
        keys = np.array([0 if k is None else k for k in self.keys], np.int64)
        order = np.lexsort((keys, nulls))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        terms, docs, tfs = np.array(self.post_terms, np.int32), place[np.array(self.of, np.int64)].astype(np.int32), np.array(self.tfs, np.int32)
        by = np.lexsort((docs, terms))
        own, counts = np.unique(terms, return_counts=True)
        row = {
            "n_docs": len(keys),
            "n_terms": sum(self.sizes),
            "terms": own,
            "counts": counts.astype(np.int32),
            "keys": keys[order].tobytes(),
            "nulls": nulls[order].tobytes(),
            "sizes": np.array(self.sizes, np.int64)[order].tobytes(),
            "docs": docs[by].tobytes(),
            "tfs": tfs[by].tobytes(),
        }
        self._clear()
        return pa.RecordBatch.from_pylist([row], schema=_SHAPE)


def index(docs: DataFrame, terms: list[bytes], *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per shard with the postings of ``terms``, which are numbered in their order."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = ShardBuilder(shared.value)
        for batch in batches:
            for who, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard.add(who, raw.as_py())
                if shard.full:
                    yield shard.row()
        if shard.keys:
            yield shard.row()

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("raw"))
    return materialize(rows.mapInArrow(build, INDEX), "lexical-index")


class Shard:
    """A shard ready for searching: impacts, and a sparse table over all lists."""

    def __init__(self, row: dict, total_docs: int, total_terms: int):
        self.n = row["n_docs"]
        self.keys = np.frombuffer(row["keys"], np.int64)
        self.nulls = np.frombuffer(row["nulls"], np.uint8)
        self.terms = np.array(row["terms"], np.int64)
        counts = np.array(row["counts"], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        self.docs = np.frombuffer(row["docs"], np.int32)
        tfs = np.frombuffer(row["tfs"], np.int32).astype(np.int64)
        norms = lengths(np.frombuffer(row["sizes"], np.int64), total_docs, total_terms)[self.docs]
        self.impact = 1_000_000_000 * tfs // (1000 * tfs + 8 * norms)
        self.place = np.repeat(np.arange(len(counts)), counts) * self.n + self.docs  # ascending: list, document
        self.table = self._sparse(int(counts.max(initial=1)))

    def _sparse(self, longest: int) -> np.ndarray:
        """Row j: where the largest impact of the 2**j postings from a place on is, the first if several are."""
        levels = [np.arange(len(self.impact), dtype=np.int32)]
        while 1 << len(levels) <= longest:
            half, last = 1 << (len(levels) - 1), levels[-1]
            level = last.copy()  # places whose run would leave the postings are never asked for
            right = last[half:]
            level[: len(right)] = np.where(self.impact[last[: len(right)]] >= self.impact[right], last[: len(right)], right)
            levels.append(level)
        return np.stack(levels)

    def peaks(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and value of the largest impact of every run [lo, hi) of a list; value 0 for an empty run."""
        empty = hi <= lo
        size = np.where(empty, 1, hi - lo)
        level = np.frexp(size)[1] - 1
        lo = np.where(empty, 0, lo)
        one = self.table[level, lo]
        two = self.table[level, lo + size - (1 << level)]
        at = np.where(self.impact[one] >= self.impact[two], one, two)
        return at, np.where(empty, 0, self.impact[at])

    def below(self, key: int, null: bool) -> int:
        """Documents whose ids come before the given one."""
        known = len(self.keys) - int(self.nulls.sum())
        return known if null else int(np.searchsorted(self.keys[:known], key))


def lengths(sizes: np.ndarray, total_docs: int, total_terms: int) -> np.ndarray:
    """The m of documents with so many terms, without overflow."""
    if 75 * total_docs * int(sizes.max(initial=0)) < 2**63:
        return 25 + 75 * sizes * total_docs // max(1, total_terms)
    some, back = np.unique(sizes, return_inverse=True)
    return np.array([25 + 75 * int(s) * total_docs // total_terms for s in some], np.int64)[back]


@dataclass
class Best:
    """The best documents found so far for an item: score descending, id ascending, null ids last."""

    k: int
    scores: np.ndarray
    keys: np.ndarray
    nulls: np.ndarray

    @classmethod
    def none(cls, k: int) -> Best:
        return cls(k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8))

    def add(self, scores: np.ndarray, keys: np.ndarray, nulls: np.ndarray) -> None:
        scores, keys, nulls = (np.concatenate(x) for x in ((self.scores, scores), (self.keys, keys), (self.nulls, nulls)))
        first = np.lexsort((keys, nulls, -scores))[: self.k]
        self.scores, self.keys, self.nulls = scores[first], keys[first], nulls[first]

    def limit(self, shard: Shard) -> tuple[int, int]:
        """The score to reach, and the place in the shard before which a tie counts."""
        if len(self.scores) < self.k:
            return 1, shard.n
        return int(self.scores[-1]), shard.below(int(self.keys[-1]), bool(self.nulls[-1]))


def search(shard: Shard, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Brings ``best`` up to date with the documents of a shard; returns how many were scored."""
    at = np.searchsorted(shard.terms, terms)
    held = at < len(shard.terms)
    held[held] = shard.terms[at[held]] == terms[held]
    at, weights = at[held], weights[held]
    if not len(at) or best.k < 1:
        return 0
    lists = at * shard.n
    lo, hi, first = shard.starts[at][None], shard.starts[at + 1][None], np.zeros(1, np.int64)
    bound, split = _bounds(shard, lo, hi, weights)
    scored = 0
    while True:
        least, edge = best.limit(shard)
        alive = (bound > least) | ((bound == least) & (first < edge))
        if not alive.any():
            return scored
        lo, hi, first, bound, split = (x[alive] for x in (lo, hi, first, bound, split))
        order = np.lexsort((first, -bound))
        now, rest = order[:SPLITS], order[SPLITS:]
        docs = split[now]
        place = np.searchsorted(shard.place, lists + docs[:, None])
        hit = (place < hi[now]) & (place >= lo[now])
        hit[hit] = shard.docs[place[hit]] == np.broadcast_to(docs[:, None], hit.shape)[hit]
        scores = np.where(hit, shard.impact[np.minimum(place, len(shard.impact) - 1)], 0) @ weights
        scored += len(docs)
        good = scores >= least
        best.add(scores[good], shard.keys[docs[good]], shard.nulls[docs[good]])
        new_lo, new_hi = np.concatenate([lo[now], place + hit]), np.concatenate([place, hi[now]])
        new_first = np.concatenate([first[now], docs + 1])
        new_bound, new_split = _bounds(shard, new_lo, new_hi, weights)
        lo, hi = np.concatenate([lo[rest], new_lo]), np.concatenate([hi[rest], new_hi])
        first, bound, split = (np.concatenate(x) for x in ((first[rest], new_first), (bound[rest], new_bound), (split[rest], new_split)))


def _bounds(shard: Shard, lo: np.ndarray, hi: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bound of every interval, and the document of its largest single share."""
    at, value = shard.peaks(lo, hi)
    shares = value * weights
    top = at[np.arange(len(at)), shares.argmax(axis=1)]
    return shares.sum(axis=1), shard.docs[top].astype(np.int64)


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    *,
    k: int = 10,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """item_key, rank (from 1), key, score: the ``k`` best documents with a score above 0 of every item."""
    asked = items.select(F.col(item_key).cast("long").alias("id"), F.col(item_text).cast("binary").alias("raw"))
    total = asked.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    n = max(1, -(-2 * total // ITEM_BYTES)) if total > ITEM_BYTES else 1
    if n > 1:  # written, so that every pass sees the same blocks
        asked = materialize(asked.withColumn("block", F.pmod(F.xxhash64("raw", "id"), F.lit(n))), "lexical-items")
    found = [_search_block(docs, asked if n == 1 else asked.where(F.col("block") == b), b, k, key, text) for b in range(n)]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    order = W.partitionBy("block", "no").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias(item_key), F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score")


def _search_block(docs: DataFrame, asked: DataFrame, block: int, k: int, key: str, text: str) -> DataFrame:
    """block, no, id, key, score: the best documents of every task for the items, which fit in the driver."""
    spark = docs.sparkSession
    held = [(r["id"], Counter(terms_of(bytes(r["raw"] or b"")))) for r in asked.select("id", "raw").collect()]
    words = sorted(set().union(*(c for _, c in held)))
    shards = index(docs, words, key=key, text=text)
    sums = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    total_docs, total_terms = int(sums[0] or 0), int(sums[1] or 0)
    pairs = shards.select(F.explode(F.arrays_zip("terms", "counts")).alias("p")).groupBy(F.col("p.terms").alias("t"))
    df = {r["t"]: r["df"] for r in pairs.agg(F.sum("p.counts").alias("df")).collect()}  # one short row a term of the items
    weight = {t: math.floor(1000 * math.log((2 * total_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    place = {w: i for i, w in enumerate(words)}
    queries = []
    for who, counts in held:
        known = sorted((place[w], n) for w, n in counts.items() if place[w] in weight)
        queries.append((who, np.array([t for t, _ in known], np.int64), np.array([n * weight[t] for t, n in known], np.int64)))
    shared = spark.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best.none(k) for _ in shared.value]
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.slice(i, 1).to_pylist()[0], total_docs, total_terms)
                for found, (_, terms, weights) in zip(best, shared.value, strict=True):
                    search(shard, terms, weights, found)
        for no, (found, (who, _, _)) in enumerate(zip(best, shared.value, strict=True)):
            if size := len(found.scores):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * size, pa.int64()),
                        pa.array([no] * size, pa.int64()),
                        pa.array([who] * size, pa.int64()),
                        pa.array(found.keys, pa.int64(), mask=found.nulls.astype(bool)),
                        pa.array(found.scores, pa.int64()),
                    ],
                    names=["block", "no", "id", "key", "score"],
                )

    return shards.mapInArrow(run, "block bigint, no bigint, id bigint, key bigint, score bigint")


def search_rows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score of the ten best documents of every item."""
    return ranked_search(docs, items)
