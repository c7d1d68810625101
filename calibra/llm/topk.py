"""Exact search for the largest inner products by a table of pivot distances.

Components are turned into integers, so scores are exact. The table holds for
every vector its distances to many pivots, which are spread over a bounded
sample. For a query the triangle inequality bounds a candidate's distance from
below by the largest difference of their pivot distances, and so the inner
product from above: <q, x> = (|q|^2 + |x|^2 - |q - x|^2) / 2. Candidates are
scored in the order of their bounds until the next bound is below the k-th best
score; what is left cannot be a result. The search starts from the k-th best
score within the sample, which is a sure lower limit.

Queries are taken in blocks of ``QUERY_BLOCK``, which are broadcast; the table
is read once for a block and never shuffled. A task returns its best
candidates for a query, as far as they reach the limit, and these are merged.

Defined results: a vector that is null, or has a null or non-finite component
(also after the scaling), takes no part; only vectors of equal length are
compared; ties go to the smaller id, null ids last, then to the earlier row; a
query is not its own candidate, but another row with its id is; scores beyond a
long are set to the nearest long; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from calibra.llm.common import materialize

PIVOTS = 32
SAMPLE = 2048  # vectors that pivots and first limits come from
QUERY_BLOCK = 4096
QUERY_SLICE = 128  # queries whose bounds are held at once
STEP = 256  # candidates that are scored at once
TABLE = "row_no bigint, id bigint, dim int, v binary, d binary"


@dataclass
class Block:
    """Vectors of one length: rows, ids (with null flags), integers, pivot distances."""

    row: np.ndarray
    id: np.ndarray
    null: np.ndarray
    v: np.ndarray
    d: np.ndarray

    @property
    def norm(self) -> np.ndarray:
        return (self.v * self.v).sum(axis=1)


def blocks(rows: list[tuple]) -> dict[int, Block]:
    """Rows of the table by the length of their vectors."""
    out: dict[int, list[tuple]] = {}
    for r in rows:
        out.setdefault(r[2], []).append(r)
    return {
        dim: Block(
            np.array([r[0] for r in rs], np.int64),
            np.array([0 if r[1] is None else r[1] for r in rs], np.int64),
            np.array([r[1] is None for r in rs]),
            np.frombuffer(b"".join(r[3] for r in rs)).reshape(len(rs), dim),
            np.frombuffer(b"".join(r[4] for r in rs)).reshape(len(rs), -1),
        )
        for dim, rs in out.items()
    }


def distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((v - p) ** 2).sum(axis=1)) for p in pivots], axis=1) if len(pivots) else np.zeros((len(v), 0))


def spread(v: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the vectors, each far from those before it."""
    chosen, near = [0], np.full(len(v), np.inf)
    while len(chosen) < min(n, len(v)):
        near = np.minimum(near, np.sqrt(((v - v[chosen[-1]]) ** 2).sum(axis=1)))
        if not near.max() > 0:
            break
        chosen.append(int(near.argmax()))
    return v[chosen]


def products(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of integer-valued rows with one vector, as longs."""
    most = float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, len(q))
    if most < 2**53:
        return (v @ q).astype(np.int64)
    if most < 2**62:
        return v.astype(np.int64) @ q.astype(np.int64)
    whole = [[int(a) * int(b) for a, b in zip(x, q.tolist(), strict=True)] for x in v.tolist()]
    return np.array([min(max(sum(x), -(2**63)), 2**63 - 1) for x in whole], np.int64)


def _order(score: np.ndarray, block: Block, at: np.ndarray) -> np.ndarray:
    return np.lexsort((block.row[at], block.id[at], block.null[at], ~score))  # ~score falls as score grows


def search(queries: Block, table: Block, limit: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For every query its place, and the places and scores of its best candidates that reach the limit."""
    out = []
    norm = table.norm
    for lo in range(0, len(queries.row), QUERY_SLICE):
        q = slice(lo, lo + QUERY_SLICE)
        far = np.zeros((len(queries.row[q]), len(table.row)))
        for p in range(table.d.shape[1]):
            np.maximum(far, np.abs(queries.d[q, p, None] - table.d[None, :, p]), out=far)
        both = queries.norm[q, None] + norm[None, :]
        bound = (both - far * far) / 2 + 1e-9 * both + 1  # what rounding can do is far less
        for i in range(len(bound)):
            least = limit[lo + i]
            rest = np.flatnonzero((bound[i] >= least) & (table.row != queries.row[lo + i]))
            rest = rest[np.argsort(-bound[i, rest], kind="stable")]
            best, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for a in range(0, len(rest), STEP):
                some = rest[a : a + STEP]
                if bound[i, some[0]] < least:
                    break
                score = products(table.v[some], queries.v[lo + i])
                hit = score >= least
                best, scores = np.concatenate([best, some[hit]]), np.concatenate([scores, score[hit]])
                first = _order(scores, table, best)[:k]
                best, scores = best[first], scores[first]
                if len(best) == k:
                    least = max(least, scores[-1])
            if len(best):
                out.append((lo + i, best, scores))
    return out


def scaled(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """row_no, id, dim, v: the vectors that take part, as integers in doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, who, x in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if x is None or None in x:
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    v = np.floor(np.array(x, float) * scale)
                if np.isfinite(v).all():
                    rows.append({"row_no": row, "id": who, "dim": len(v), "v": v.tobytes()})
            shape = pa.schema([("row_no", pa.int64()), ("id", pa.int64()), ("dim", pa.int32()), ("v", pa.binary())])
            yield pa.RecordBatch.from_pylist(rows, schema=shape)

    rows = vectors.select(
        F.monotonically_increasing_id().alias("row_no"), F.col(key).cast("long").alias("id"), F.col(vector).alias("x")
    )
    return rows.mapInArrow(run, "row_no bigint, id bigint, dim int, v binary")


def exact_top_k(
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: int = 1024,
    pivots: int = PIVOTS,
) -> DataFrame:
    """query_id, rank (from 1), id, score of the ``k`` best rows for every query.

    ``is_query`` is a condition on ``id``, the rows' key.
    """
    spark = vectors.sparkSession
    rows = materialize(scaled(vectors, key, vector, scale), "topk-vectors")
    sample = rows.orderBy(F.xxhash64("id", "row_no")).limit(SAMPLE).collect()
    known = blocks([(*r, b"") for r in sample])
    chosen = {dim: spread(b.v, pivots) for dim, b in known.items()}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = []
            for dim, v in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                d.append(distances(np.frombuffer(v)[None], chosen.get(dim, np.zeros((0, dim)))).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d, pa.binary())], names=["row_no", "id", "dim", "v", "d"])

    table = materialize(rows.mapInArrow(measure, TABLE), "topk-pivots")
    asked = table.where(is_query)
    count = asked.count()
    numbered = materialize(
        asked.withColumn("block", F.pmod(F.xxhash64("row_no"), F.lit(max(1, -(-count // (QUERY_BLOCK // 2)))))), "topk-queries"
    )
    for b in known.values():
        b.d = np.zeros((len(b.row), 0))
    parts = []
    for r in numbered.groupBy("block").count().orderBy("block").collect():  # one row per block of queries
        held = blocks([tuple(x) for x in numbered.where(F.col("block") == r["block"]).drop("block").collect()])
        limits = {dim: _first_limits(q, known.get(dim), k) for dim, q in held.items()}
        parts.append(materialize(_search_block(table, spark.sparkContext.broadcast((held, limits)), k), "topk-found"))
    if not parts:
        return spark.createDataFrame([], "query_id bigint, rank int, id bigint, score bigint")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = W.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row_no")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "id", "score")


def _first_limits(queries: Block, sample: Block | None, k: int) -> np.ndarray:
    """The k-th best score of every query within the sample, or no limit."""
    out = np.full(len(queries.row), -(2**63), np.int64)
    if sample is not None:
        for i in range(len(queries.row)):
            scores = products(sample.v[sample.row != queries.row[i]], queries.v[i])
            if len(scores) >= k:
                out[i] = np.partition(scores, len(scores) - k)[len(scores) - k]
    return out


def _search_block(table: DataFrame, shared: object, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, limits = shared.value
        names = ["query_row", "query_id", "row_no", "id", "score"]
        for batch in batches:
            found = []
            for dim, part in blocks(list(zip(*[c.to_pylist() for c in batch.columns], strict=True))).items():
                if dim not in held:
                    continue
                queries = held[dim]
                for q, best, scores in search(queries, part, limits[dim], k):
                    if len(best) == k:
                        limits[dim][q] = max(limits[dim][q], scores[-1])  # other batches must reach it
                    for at, score in zip(best.tolist(), scores.tolist(), strict=True):
                        who = None if part.null[at] else int(part.id[at])
                        asks = None if queries.null[q] else int(queries.id[q])
                        found.append((int(queries.row[q]), asks, int(part.row[at]), who, score))
            columns = list(zip(*found, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return table.mapInArrow(run, "query_row bigint, query_id bigint, row_no bigint, id bigint, score bigint")


def top_rows(vectors: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by 100."""
    return exact_top_k(vectors, F.col("id") % 100 == 0).withColumnRenamed("id", "vec_id")
