"""Hard negatives by lists that the anchors of a cluster share.

Anchors are clustered by direction around centroids, which are fitted on a
bounded sample of them. For a cluster with centroid c and widest angle t, no
member q can have a larger product with a row x than
``|q| * |x| * cos(max(0, angle(x, c) - t))``. A task sorts its rows by this
bound once for a cluster, |q| left out, and all members walk the one list in
steps; a member leaves when the next bound, times its norm, is below what it
still needs. Scores are exact integers.

There are two walks: one for the positives, the best other rows of an anchor's
label, and one for the negatives, the best rows of other labels whose score is
within a band of the positive's. What a member needs is at first the floor of
the band or the place it would have in a bounded sample of all rows, and rises
with what the task has found for it. The best of all tasks are merged.

The table is read where it lies when the anchors are few (at most
``BROADCAST_BYTES``, counted). Otherwise groups of whole clusters, of bounded
size, meet slices of the table by a shuffle on group and slice: a row is sent
once for each group, and no key has more than one slice and one group.

Defined results: rows with a null label, or a vector that is null or has a null
or non-finite component (also after the scaling), take no part; labels are
whole numbers; only vectors of equal length are compared; ties go to the
smaller id, null ids last, then to the earlier row; an anchor is not its own
positive, but another row with its id is; a row that is twice a positive gives
two lists; scores beyond a long are set to the nearest long; an anchor without
positives, and a positive without negatives in its band, give no rows; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from calibra.llm.common import materialize
from calibra.llm.topk import products

SAMPLE = 2048  # rows for first limits, and anchors for the centroids
MEMBERS, CENTROIDS = 32, 256  # anchors a cluster should have, clusters at most
STEP = 512  # rows of a list that are scored at once
BROADCAST_BYTES = 32 << 20
GROUP_ANCHORS, SLICE_ROWS = 4096, 16_384  # of the shuffled form
LOWEST = -(2**63)

ROWS = "row_no bigint, id bigint, label bigint, dim int, v binary"
FOUND = "anchor_row bigint, list int, row_no bigint, id bigint, score bigint"


def scaled(vectors: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """row_no, id, label, dim, v: the rows that take part, whole-number components in doubles."""
    rows = vectors.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(
        F.monotonically_increasing_id().alias("row_no"),
        F.col(key).cast("long").alias("id"),
        F.col(label).cast("long").alias("label"),
        F.col(vector).cast("array<double>").alias("x"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(3)
            size = pc.list_value_length(x).to_numpy()
            with np.errstate(over="ignore", invalid="ignore"):
                flat = np.floor(pc.list_flatten(x).to_numpy(zero_copy_only=False) * scale)  # a null is not a number here
            ends = np.cumsum(size, dtype=np.int64)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            keep = bad[ends] == bad[ends - size]
            flat = np.where(np.isfinite(flat), flat, 0)
            offsets = pa.py_buffer(np.concatenate([[0], 8 * ends]).astype(np.int32))
            v = pa.Array.from_buffers(pa.binary(), len(size), [None, offsets, pa.py_buffer(flat)])
            out = pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(size, pa.int32()), v], names=["row_no", "id", "label", "dim", "v"])
            yield out.filter(pa.array(keep))

    return rows.mapInArrow(run, ROWS)


@dataclass
class Block:
    """Rows of one length: row numbers, ids with null flags, labels, components."""

    row: np.ndarray
    id: np.ndarray
    null: np.ndarray
    label: np.ndarray
    v: np.ndarray

    def take(self, at: np.ndarray) -> Block:
        return Block(self.row[at], self.id[at], self.null[at], self.label[at], self.v[at])

    @property
    def norm(self) -> np.ndarray:
        return np.sqrt((self.v * self.v).sum(axis=1))


def blocks(rows: pa.RecordBatch | pa.Table) -> dict[int, Block]:
    """Rows by the length of their vectors."""
    out = {}
    dims = rows.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        some = rows.filter(pa.array(dims == dim))
        ids = some.column("id")
        out[dim] = Block(
            some.column("row_no").to_numpy(),
            pc.fill_null(ids, 0).to_numpy(),
            pc.is_null(ids).to_numpy(zero_copy_only=False),
            some.column("label").to_numpy(),
            np.frombuffer(b"".join(some.column("v").to_pylist())).reshape(some.num_rows, dim),
        )
    return out


@dataclass
class Lists:
    """What one anchor looks for: for each list the scores it takes, and the best found so far.

    ``same`` tells whether rows of the anchor's label or of other labels count.
    """

    k: int
    same: bool
    low: list[int]
    high: list[int]
    best: list[np.ndarray] = field(default_factory=list)  # columns: score, null, id, row

    def __post_init__(self) -> None:
        self.best = [np.zeros((0, 4), np.int64) for _ in self.low]
        self.need = list(self.low)

    @property
    def least(self) -> int:
        """The lowest score that any list still takes."""
        return min((n for n, h in zip(self.need, self.high, strict=True) if n <= h), default=2**63 - 1)

    def offer(self, scores: np.ndarray, rows: Block) -> None:
        for i, (low, high) in enumerate(zip(self.need, self.high, strict=True)):
            at = np.flatnonzero((scores >= low) & (scores <= high))
            if not len(at):
                continue
            new = np.stack([scores[at], rows.null[at].astype(np.int64), rows.id[at], rows.row[at]], axis=1)
            held = np.concatenate([self.best[i], new])
            self.best[i] = held[np.lexsort((held[:, 3], held[:, 2], held[:, 1], ~held[:, 0]))][: self.k]
            if len(self.best[i]) == self.k:
                self.need[i] = max(low, int(self.best[i][-1, 0]))


@dataclass
class Cluster:
    """Anchors around a centroid, their lists, and how far they are from it."""

    anchors: Block
    lists: list[Lists]
    centroid: np.ndarray

    def __post_init__(self) -> None:
        self.norm = self.anchors.norm
        self.width = float(angles(self.anchors.v, self.norm, self.centroid).max(initial=0))


def angles(v: np.ndarray, norm: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """The angle of every row to a unit vector; a zero row is anywhere, so it counts as far."""
    cosine = np.divide(v @ centroid, norm, out=np.full(len(v), -1.0), where=norm > 0)
    return np.arccos(np.clip(cosine, -1, 1))


def walk(cluster: Cluster, rows: Block, norm: np.ndarray) -> int:
    """All members walk the rows in the order of the shared bound; returns the scores computed."""
    gap = np.maximum(0, angles(rows.v, norm, cluster.centroid) - cluster.width - 1e-7)  # what rounding can do is less
    bound = norm * np.cos(gap)
    order = np.argsort(-bound, kind="stable")
    bound = bound[order]
    active, scored = np.arange(len(cluster.lists)), 0
    for lo in range(0, len(order), STEP):
        reach = cluster.norm[active] * bound[lo] + 1e-9 * cluster.norm[active] * norm.max() + 1
        active = active[reach >= [cluster.lists[m].least for m in active]]
        if not len(active):
            break
        some = rows.take(order[lo : lo + STEP])
        scores = product_table(some.v, cluster.anchors.v[active])
        scored += scores.size
        for m, found in zip(active.tolist(), scores.T, strict=True):
            lists = cluster.lists[m]
            fits = (some.label == cluster.anchors.label[m]) == lists.same
            fits &= (found >= lists.least) & (some.row != cluster.anchors.row[m])
            if fits.any():
                at = np.flatnonzero(fits)
                lists.offer(found[at], some.take(at))
    return scored


def product_table(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``v`` with all rows of ``q``."""
    most = float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, v.shape[1])
    if most < 2**53:
        return (v @ q.T).astype(np.int64)
    return np.stack([products(v, x) for x in q], axis=1)


def centroids(anchors: np.ndarray, n: int, turns: int = 8) -> np.ndarray:
    """``n`` unit vectors at most, by a few turns of spherical k-means."""
    norm = np.sqrt((anchors * anchors).sum(axis=1))
    unit = anchors[norm > 0] / norm[norm > 0, None]
    if not len(unit):
        return np.zeros((1, anchors.shape[1]))
    centre = unit[np.linspace(0, len(unit) - 1, min(n, len(unit))).astype(int)]
    for _ in range(turns):
        of = (unit @ centre.T).argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, of, unit)
        size = np.sqrt((total * total).sum(axis=1))
        centre = np.where(size[:, None] > 0, total / np.maximum(size, 1e-300)[:, None], centre)
    return centre


def clusters(anchors: dict[int, Block], lists: dict[int, Lists], centres: dict[int, np.ndarray]) -> dict[int, list[Cluster]]:
    """The anchors around their nearest centroids; ``lists`` by row number."""
    out: dict[int, list[Cluster]] = {}
    for dim, block in anchors.items():
        centre = centres.get(dim, np.zeros((1, dim)))
        of = (block.v @ centre.T).argmax(axis=1)
        for c in np.unique(of).tolist():
            some = block.take(np.flatnonzero(of == c))
            out.setdefault(dim, []).append(Cluster(some, [lists[r] for r in some.row.tolist()], centre[c]))
    return out


def _found(held: dict[int, list[Cluster]]) -> Iterator[pa.RecordBatch]:
    """All lists of the clusters as rows."""
    for group in held.values():
        for cluster in group:
            out = [
                np.concatenate([np.full((len(b), 1), row), np.full((len(b), 1), i), b], axis=1)
                for row, lists in zip(cluster.anchors.row.tolist(), cluster.lists, strict=True)
                for i, b in enumerate(lists.best)
                if len(b)
            ]
            if out:
                a = np.concatenate(out)
                columns = [pa.array(a[:, 0]), pa.array(a[:, 1].astype(np.int32)), pa.array(a[:, 5]), pa.array(a[:, 4], mask=a[:, 3] > 0), pa.array(a[:, 2])]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor_row", "list", "row_no", "id", "score"])


def _walk_all(held: dict[int, list[Cluster]], rows: pa.RecordBatch | pa.Table) -> None:
    for dim, block in blocks(rows).items():
        norm = block.norm
        for cluster in held.get(dim, []):
            walk(cluster, block, norm)


@dataclass
class Task:
    """How the lists of the anchors look: how many, which scores, and which rows of a sample set first limits."""

    k: int
    same: bool
    band: tuple[int, int] | None
    centres: dict[int, np.ndarray]
    sample: dict[int, Block]

    def lists(self, positives: list[int] | None) -> Lists:
        if self.band is None:
            return Lists(self.k, self.same, [LOWEST], [2**63 - 1])
        low, high = self.band
        positives = positives or []
        return Lists(self.k, self.same, [-(-low * s // 100) for s in positives], [high * s // 100 for s in positives])

    def clusters(self, anchors: pa.RecordBatch | pa.Table) -> dict[int, list[Cluster]]:
        """The clusters with what the sample says they need at least."""
        scores = dict(zip(anchors.column("row_no").to_pylist(), anchors.column("scores").to_pylist(), strict=True))
        held = clusters(blocks(anchors), {r: self.lists(s) for r, s in scores.items()}, self.centres)
        for dim, group in held.items():
            if dim in self.sample:
                sample = self.sample[dim]
                for cluster in group:
                    walk(cluster, sample, sample.norm)
                    for lists in cluster.lists:  # the limits stay; the rows come again from the table
                        lists.best = [np.zeros((0, 4), np.int64) for _ in lists.low]
        return held


def _search(rows: DataFrame, anchors: DataFrame, task: Task, most_broadcast: int) -> DataFrame:
    """FOUND: the best rows of every task for the lists of the anchors (ROWS and ``scores array<bigint>``)."""
    spark = rows.sparkSession
    size = anchors.agg(F.sum(F.octet_length("v") + 64 + 8 * F.coalesce(F.size("scores"), F.lit(0))), F.count(F.lit(1))).first()
    if not size[1]:
        return spark.createDataFrame([], FOUND)
    if size[0] <= most_broadcast:
        shared = spark.sparkContext.broadcast((task, anchors.toArrow()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one, table = shared.value
            held = one.clusters(table)
            for batch in batches:
                _walk_all(held, batch)
            yield from _found(held)

        return rows.mapInArrow(run, FOUND)
    spread = spark.sparkContext.broadcast(task)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = spread.value.centres
        for batch in batches:
            of = np.zeros(batch.num_rows, np.int32)
            at = {r: i for i, r in enumerate(batch.column("row_no").to_pylist())}
            for dim, block in blocks(batch).items():
                if dim in centres:
                    of[[at[r] for r in block.row.tolist()]] = (block.v @ centres[dim].T).argmax(axis=1)
            yield batch.append_column("cluster", pa.array(of))

    placed = materialize(anchors.mapInArrow(near, f"{ROWS}, scores array<bigint>, cluster int"), "negatives-anchors")
    groups, of = 0, []
    room = 0
    for r in placed.groupBy("dim", "cluster").count().orderBy("dim", "cluster").collect():  # CENTROIDS rows a length at most
        parts = -(-r["count"] // GROUP_ANCHORS)
        if parts > 1 or room < r["count"]:
            groups, room = groups + 1, GROUP_ANCHORS
        of.append((r["dim"], r["cluster"], groups - 1, parts))
        room, groups = (room - r["count"], groups) if parts == 1 else (0, groups + parts - 1)
    deal = spark.createDataFrame(of, "dim int, cluster int, base int, parts int")
    slices = max(1, -(-rows.count() // SLICE_ROWS))
    left = placed.join(F.broadcast(deal), ["dim", "cluster"])
    left = left.withColumn("grp", F.col("base") + F.pmod(F.xxhash64("row_no"), F.col("parts")).cast("int")).drop("base", "parts", "cluster")
    left = left.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    right = rows.withColumn("slice", F.pmod(F.xxhash64("row_no"), F.lit(slices)).cast("int"))
    right = right.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        held = spread.value.clusters(a) if a.num_rows else {}
        if b.num_rows:
            _walk_all(held, b)
        none = pa.table({n: pa.array([], t) for n, t in (("anchor_row", pa.int64()), ("list", pa.int32()), ("row_no", pa.int64()), ("id", pa.int64()), ("score", pa.int64()))})
        return pa.concat_tables([none, *(pa.Table.from_batches([x]) for x in _found(held))])

    return left.groupBy("grp", "slice").cogroup(right.groupBy("grp", "slice")).applyInArrow(meet, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("anchor_row", "list").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row_no")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    *,
    positives: int = 5,
    k: int = 10,
    band: tuple[int, int] = (30, 90),
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: int = 256,
    most_broadcast: int = BROADCAST_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on ``id``, the rows' key; ``band`` has the
    lowest and the highest score of a negative in hundredths of the positive's.
    """
    rows = materialize(scaled(vectors, key, vector, label, scale), "negatives-rows")
    anchors = rows.where(is_anchor)
    count = anchors.count()
    some = blocks(rows.orderBy(F.xxhash64("id", "row_no")).limit(SAMPLE).toArrow())
    own = blocks(anchors.orderBy(F.xxhash64("id", "row_no")).limit(SAMPLE).toArrow())
    centres = {d: centroids(b.v, min(CENTROIDS, max(1, count // MEMBERS))) for d, b in own.items()}
    task = Task(positives, True, None, centres, some)
    first = _search(rows, anchors.withColumn("scores", F.lit(None).cast("array<bigint>")), task, most_broadcast)
    best = _ranked(first, positives).select("anchor_row", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    best = materialize(best, "negatives-positives")
    scores = best.groupBy(F.col("anchor_row").alias("row_no")).agg(F.sort_array(F.collect_list(F.struct("rank", "positive_score"))).alias("s"))
    scores = scores.select("row_no", F.col("s.positive_score").alias("scores"))  # at most ``positives`` numbers an anchor
    asked = materialize(anchors.join(scores, "row_no").select("row_no", "id", "label", "dim", "v", "scores"), "negatives-asked")
    found = _ranked(_search(rows, asked, Task(k, False, band, centres, some), most_broadcast), k)
    best = best.withColumn("list", F.col("rank") - 1).drop("rank")
    named = asked.select(F.col("row_no").alias("anchor_row"), F.col("id").alias("anchor_id"))
    return (
        found.select("anchor_row", "list", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(best, ["anchor_row", "list"])
        .join(named, "anchor_row")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def negative_rows(vectors: DataFrame) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by 100; every seventh id's label is moved on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("id") % 100 == 0)
