"""Exact nearest neighbours as bounded block joins.

Points are cut into cells around pivots, about two for ``block`` points, and
cells are put together on shelves of ``SHELF_BYTES``. A query visits only the
cells that the triangle inequality cannot rule out, so close clusters never
meet; it travels once to a shelf, whatever number of cells it visits there, and
brings back its nearest of the whole shelf. Copies of one vector count once: a
point keeps the first ``k + 1`` member ids of each distinct vector, which is all
any query can use, and the results are joined back to the copies. Every task
holds one shelf and as many queries, whatever the data looks like. Only groups
of more than ``2 * block`` vectors are cut into cells; the table of all others
stays distributed, so any number of groups is searched.

``approximate`` names a recall instead: then random-projection tables
(``operators.hashed``) find the candidates, and exact search is the default.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibra.session import BROADCAST_ROW_BOUND, materialize, small_side

BLOCK_ROWS = 4096
MAX_PIVOTS = 256
SHELF_BYTES = 16 << 20  # vectors of one side that a task holds
MIN_PART = 512  # queries that are worth a task of their own
CHUNK_CELLS = 1 << 20  # distances held at once inside a task


def vector_digest(vector: Column) -> Column:
    return F.md5(vector.cast("array<double>").cast("string"))


def _usable(vector: str) -> Column:
    """A vector of numbers; a difference with itself is null or not zero for all else."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: F.coalesce(x - x == 0, F.lit(False)))


def _points(df: DataFrame, key: str, vector: str, group: str | None, payload: str | None) -> DataFrame:
    vec = F.col(vector).cast("array<double>")
    return df.select(
        (F.col(group).cast("string") if group else F.lit("")).alias("grp"),
        vector_digest(vec).alias("digest"),
        F.col(key).alias("id"),
        (F.col(payload) if payload else F.lit(None).cast("int")).alias("payload"),
        vec.alias("vec"),
    )


def _distinct_base(points: DataFrame, k: int) -> DataFrame:
    # The rank filter is applied before the shuffle as well (group limit), so a
    # vector with very many copies sends k + 1 rows per task.
    order = Window.partitionBy("grp", "digest").orderBy("id")
    kept = points.withColumn("__rn", F.row_number().over(order)).filter(F.col("__rn") <= k + 1)
    return kept.groupBy("grp", "digest").agg(
        F.first("vec").alias("vec"),
        F.sort_array(F.collect_list(F.struct("id", "payload"))).alias("members"),
        F.min("id").alias("low"),
    )


def _stack(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()).astype(float)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` to the few rows of ``b``, from differences.

    Squared norms would lose the distance when the values share a large offset.
    """
    out = np.empty((len(a), len(b)))
    for j, point in enumerate(b):
        out[:, j] = np.sqrt(((a - point) ** 2).sum(1))
    return out


def _assign(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the nearest pivot (``cell``) and the distance to it."""
    schema = T.StructType(df.schema.fields + [T.StructField("cell", T.IntegerType()), T.StructField("radius", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                d = _distances(_stack(batch["vec"]), pivots)
                cell = d.argmin(1)
                yield batch.assign(cell=cell.astype("int32"), radius=d[np.arange(len(d)), cell])

    return df.mapInPandas(run, schema)


class _Nearest:
    """The ``take`` nearest points so far of every query a task holds, by (exact distance, rank of the id).

    ``bound`` is a distance beyond which a query's neighbours cannot lie; it
    falls to the last kept distance as points come in.
    """

    def __init__(self, queries: np.ndarray, bound: np.ndarray, take: int) -> None:
        self.queries, self.bound, self.take = queries, bound.copy(), take
        self.distance = np.full((len(queries), take), np.inf)
        self.rank = np.full((len(queries), take), np.iinfo(np.int64).max)
        self.point = np.full((len(queries), take), -1)

    def see(self, who: np.ndarray, points: np.ndarray, rank: np.ndarray, first: int) -> None:
        """Show ``points``, which have the places from ``first``, to the queries ``who``.

        A matrix product finds candidates with a safety margin; their distances
        are then computed by differences, so the order does not depend on the
        block.
        """
        centre = points.mean(0)  # norms from here keep their digits when all values share an offset
        near = points - centre
        norms = (near * near).sum(1)
        turned = np.column_stack([near, norms]).T
        keep = min(self.take, len(points))
        step = max(1, CHUNK_CELLS // len(points))
        for start in range(0, len(who), step):
            part = who[start : start + step]
            moved = self.queries[part] - centre
            own = (moved * moved).sum(1)
            rough = np.column_stack([-2.0 * moved, np.ones(len(part))]) @ turned
            margin = 1e-9 * (1.0 + norms.max() + own)
            hit = rough <= (self.bound[part] ** 2 - own + margin)[:, None]
            many = np.flatnonzero(np.count_nonzero(hit, axis=1) > 4 * self.take)
            if len(many):
                last = np.partition(rough[many], keep - 1, axis=1)[:, keep - 1]
                hit[many] &= rough[many] <= (last + 2.0 * margin[many])[:, None]
            q, p = np.nonzero(hit)
            pairs = max(1, CHUNK_CELLS // points.shape[1])
            for i in range(0, len(q), pairs):
                asked, seen = part[q[i : i + pairs]], p[i : i + pairs]
                exact = np.sqrt(((points[seen] - self.queries[asked]) ** 2).sum(1))
                good = exact <= self.bound[asked]
                self._merge(asked[good], exact[good], rank[seen[good]], seen[good] + first)

    def _merge(self, asked: np.ndarray, distance: np.ndarray, rank: np.ndarray, point: np.ndarray) -> None:
        rows = np.unique(asked)
        row = np.concatenate([np.repeat(rows, self.take), asked])
        held = [np.concatenate([old[rows].ravel(), new]) for old, new in ((self.distance, distance), (self.rank, rank), (self.point, point))]
        order = np.lexsort((held[1], held[0], row))
        row = row[order]
        best = order[np.arange(len(row)) - np.searchsorted(row, row) < self.take]  # every row has that many
        self.distance[rows], self.rank[rows], self.point[rows] = (h[best].reshape(-1, self.take) for h in held)
        self.bound[rows] = np.minimum(self.bound[rows], self.distance[rows, -1])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query places, point places and distances."""
        q, at = np.nonzero(self.point >= 0)
        return q, self.point[q, at], self.distance[q, at]


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("vec").combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), len(values) // len(column))


def side_rows(df: DataFrame) -> int:
    """Rows of one side that a task holds: ``SHELF_BYTES`` of vectors."""
    return max(1, SHELF_BYTES // (8 * max(1, df.select(F.size("vec")).first()[0])))


def _ask_all(left: pa.Table) -> Callable:
    everyone = np.arange(left.num_rows)
    return lambda near, cell: everyone


def _ask_listed(left: pa.Table) -> Callable:
    """The queries that name the cell in their list ``cells``."""
    lists = left.column("cells").combine_chunks()
    cells = lists.flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(cells, kind="stable")
    owner = np.repeat(np.arange(len(lists), dtype="int32"), lists.value_lengths().to_numpy(zero_copy_only=False))[order]
    cells = cells[order]
    return lambda near, cell: owner[slice(*np.searchsorted(cells, [cell, cell + 1]))]


def _shelf_join(
    queries: DataFrame, base: DataFrame, keys: list[str], take: int, rows: int, ask: Callable = _ask_all, bounds_only: bool = False,
) -> DataFrame:
    """Rows ``(grp, digest, near, low, distance)``: up to ``take`` per query and shelf.

    A shelf is the base rows with the same ``keys``, in cells (``cell``); a
    query has one row for each shelf it visits, however many of its cells. A
    shelf with many visiting queries is copied to as many tasks as they need, so
    a task holds one shelf and ``rows`` queries. ``ask(queries)`` gives a
    function of the running lists and a cell: the places of its visitors.
    ``bounds_only`` returns the queries ``(grp, digest, vec, bound)`` instead,
    with the distance of the last of ``take`` neighbours found.
    """
    spark = queries.sparkSession
    cores = spark.sparkContext.defaultParallelism
    load = materialize(queries.groupBy(*keys).agg(F.count(F.lit(1)).alias("asked")), "load")
    shelves, total = load.agg(F.count(F.lit(1)), F.coalesce(F.sum("asked"), F.lit(0))).first()
    even = max(MIN_PART, -(-total // (4 * cores)))  # few shelves still keep all cores busy
    parts = load.select(*keys, F.ceil(F.col("asked") / min(rows, even)).cast("int").alias("parts"))
    known = small_side(parts, shelves)
    on = [*keys, "part"]
    left = queries.join(known, keys).withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int"))
    right = base.join(known, keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    kind = "grp string, digest string, vec array<double>, bound double"
    if not bounds_only:
        kind = f"grp string, digest string, near string, low {base.schema['low'].dataType.simpleString()}, distance double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c.split()[0]: [] for c in kind.split(", ")})
        right = right.sort_by("cell")
        points, cells = _matrix(right), right.column("cell").to_numpy()
        rank = pc.rank(right.column("low"), null_placement="at_start", tiebreaker="dense").to_numpy().astype("int64")
        near = _Nearest(_matrix(left), left.column("bound").to_numpy() * (1.0 + 1e-9), take)
        visitors = ask(left)
        starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        for lo, hi in zip(starts, [*starts[1:], len(cells)], strict=True):
            who = visitors(near, int(cells[lo]))
            if len(who):
                near.see(who, points[lo:hi], rank[lo:hi], lo)
        if bounds_only:
            return left.select(["grp", "digest", "vec"]).append_column("bound", pa.array(near.distance[:, -1]))
        q, p, distance = near.found()
        q, p = left.select(["grp", "digest"]).take(q), right.select(["digest", "low"]).take(p)
        return pa.table({"grp": q["grp"], "digest": q["digest"], "near": p["digest"], "low": p["low"], "distance": distance})

    # The shelves are small in bytes and heavy in work, so a fixed partition count
    # keeps the adaptive planner from merging them into few tasks.
    tasks = max(1, min(2 * int(parts.agg(F.sum("parts")).first()[0] or 0), 32 * cores))
    asked = ["grp", "digest", "vec", "bound", *(c for c in ("cells", "cut") if c in queries.columns)]
    left = left.select(*dict.fromkeys([*asked, *on])).repartition(tasks, *on)
    right = right.select(*dict.fromkeys(["digest", "vec", "low", "cell", *on])).repartition(tasks, *on)
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(run, kind)


def nearest(
    queries: DataFrame,
    base: DataFrame,
    key: str,
    vector: str,
    k: int,
    group: str | None = None,
    payload: str | None = None,
    exclude_self: bool = True,
    block: int = BLOCK_ROWS,
    max_pivots: int = MAX_PIVOTS,
    approximate: float | None = None,
) -> DataFrame:
    """The ``k`` nearest base rows of each query row (Euclidean), exact by default.

    Returns ``(key, neighbors)`` with ``neighbors`` an array of
    ``(distance, id, payload)`` ordered by distance, then id. With ``group``
    only rows of the same group are neighbours. ``approximate`` is the share of
    the true neighbours that a sample of the queries must find. A row without a
    vector, or with a component that is no number, is no neighbour and has none.
    """
    points = materialize(_distinct_base(_points(base, key, vector, group, payload).filter(_usable("vec")), k), "points")
    asked = _points(queries, key, vector, group, None)
    nothing = F.array().cast(_neighbor_type(base, key, payload))
    if points.isEmpty():
        return queries.select(key, nothing.alias("neighbors"))
    distinct = asked.filter(_usable("vec")).groupBy("grp", "digest").agg(F.first("vec").alias("vec"))
    distinct = materialize(distinct, "asked")
    if approximate is None:
        found = _exact(distinct, points, k + 1, block, max_pivots)
    else:
        from calibra.operators.hashed import hashed_pairs  # it uses this module

        found = hashed_pairs(distinct, points, k + 1, block, approximate)
    lists = _lists(found, points, k + 1)
    kept = F.filter("near_rows", lambda r: r["id"] != F.col("id")) if exclude_self else F.col("near_rows")
    joined = asked.select("grp", "digest", "id").join(lists, ["grp", "digest"], "left")
    return joined.select(F.col("id").alias(key), F.coalesce(F.slice(kept, 1, k), nothing).alias("neighbors"))


def _lists(found: DataFrame, points: DataFrame, take: int) -> DataFrame:
    """``near_rows`` of every query vector: the rows behind its nearest vectors, by distance, then id."""
    best = Window.partitionBy("grp", "digest").orderBy("distance", "low")
    members = points.select("grp", F.col("digest").alias("near"), "members")
    top = (
        found.withColumn("__rn", F.row_number().over(best))
        .filter(F.col("__rn") <= take)
        .join(members, ["grp", "near"])
        .groupBy("grp", "digest")
        .agg(F.collect_list(F.struct("distance", "members")).alias("parts"))
    )
    rows = F.flatten(
        F.transform(
            "parts",
            lambda p: F.transform(
                p["members"], lambda m: F.struct(p["distance"].alias("distance"), m["id"].alias("id"), m["payload"].alias("payload"))
            ),
        )
    )
    return top.select("grp", "digest", F.slice(F.array_sort(rows), 1, take).alias("near_rows"))


def _exact(distinct: DataFrame, points: DataFrame, take: int, block: int, max_pivots: int) -> DataFrame:
    """Rows ``(grp, digest, near, distance)`` that hold the ``take`` nearest vectors of every query vector."""
    plain = points.select("grp", "digest", "vec", "low")
    sizes = materialize(plain.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "group-sizes")
    groups, wide = sizes.agg(F.count(F.lit(1)), F.count(F.when(F.col("n") > 2 * block, 1))).first()
    # The cell table has one row per large group and pivot and is kept within the bound.
    wanted = min(max_pivots, BROADCAST_ROW_BOUND // max(1, wide), -(-2 * points.count() // block))
    if not wide or wanted < 2:
        return _single_cells(distinct, plain, sizes, groups, take, block)
    large = materialize(sizes.filter(F.col("n") > 2 * block), "large-groups")
    pick = lambda df, how: df.join(small_side(large.select("grp"), wide), "grp", how)
    found = _celled(pick(distinct, "left_semi"), pick(plain, "left_semi"), take, block, wanted)
    if wide == groups:
        return found
    small = sizes.filter(F.col("n") <= 2 * block)
    return found.unionByName(_single_cells(pick(distinct, "left_anti"), pick(plain, "left_anti"), small, groups, take, block))


def _single_cells(distinct: DataFrame, plain: DataFrame, sizes: DataFrame, groups: int, take: int, block: int) -> DataFrame:
    """One cell per group, which all its queries visit."""
    rows = side_rows(plain)
    blocks = sizes.select("grp", F.ceil(F.col("n") / rows).cast("int").alias("blocks"))
    known = small_side(blocks, groups)
    salted = plain.join(known, "grp").withColumn("cell", F.lit(0))
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    visits = distinct.join(known, "grp").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return _shelf_join(visits.withColumn("bound", F.lit(float("inf"))), salted, ["grp", "salt"], take, rows)


def _celled(distinct: DataFrame, plain: DataFrame, take: int, block: int, wanted: int) -> DataFrame:
    """Cells around ``wanted`` pivots; a query visits those that may hold a neighbour."""
    pivots = _stack(plain.orderBy(F.md5("digest"), "grp").limit(wanted).select("vec").toPandas()["vec"])
    rows = side_rows(plain)
    celled = materialize(_assign(plain, pivots), "cells")
    table = celled.groupBy("grp", "cell").agg(F.max("radius").alias("radius"), F.count(F.lit(1)).alias("n")).toPandas()
    table = _on_shelves(table, rows)
    known = plain.sparkSession.createDataFrame(
        [tuple(r) for r in table[["grp", "cell", "shelf", "pieces"]].astype(object).to_numpy().tolist()],
        "grp string, cell int, shelf int, pieces int",
    )
    piece = F.pmod(F.xxhash64("digest"), F.col("pieces")).cast("int")
    shelved = celled.join(F.broadcast(known), ["grp", "cell"]).withColumn("shelf", F.col("shelf") + piece)
    bounds = _local_bounds(distinct, shelved, pivots, table, take, rows)
    reach = {(r.grp, r.cell): r.radius for r in table.itertuples()}

    def ask(left: pa.Table) -> Callable:
        grp = left.column("grp")[0].as_py()  # a shelf belongs to one group

        def visitors(near: _Nearest, cell: int) -> np.ndarray:
            d = _distances(near.queries, pivots[[cell]])[:, 0]
            return np.flatnonzero(d - reach[grp, cell] <= near.bound + 1e-7 * (1.0 + d.max()))

        return visitors

    return _shelf_join(_visits(bounds, pivots, table, rows), shelved, ["shelf"], take, rows, ask)


def _on_shelves(table: pd.DataFrame, rows: int) -> pd.DataFrame:
    """The table of cells with the first ``shelf`` of each and the number of shelves it fills (``pieces``).

    Cells of a group share a shelf as long as it has at most ``rows`` points; a
    larger cell has shelves of its own.
    """
    table = table.sort_values(["grp", "cell"])
    shelf, fill, of = -1, rows, None
    first, pieces = [], []
    for grp, n in zip(table["grp"], table["n"], strict=True):
        needed = -(-int(n) // rows)
        if grp != of or needed > 1 or fill + n > rows:
            shelf, fill = shelf + 1, 0
        first.append(shelf)
        pieces.append(needed)
        shelf += needed - 1
        fill, of = (rows if needed > 1 else fill + int(n)), grp
    return table.assign(shelf=first, pieces=pieces)


def _neighbor_type(base: DataFrame, key: str, payload: str | None) -> T.ArrayType:
    return T.ArrayType(
        T.StructType(
            [
                T.StructField("distance", T.DoubleType()),
                T.StructField("id", base.schema[key].dataType),
                T.StructField("payload", base.schema[payload].dataType if payload else T.IntegerType()),
            ]
        )
    )


def _cell_arrays(table: pd.DataFrame) -> dict[str, tuple[np.ndarray, ...]]:
    """``(cell, radius, shelf, pieces)`` of the cells of every group."""
    return {grp: tuple(t[c].to_numpy() for c in ("cell", "radius", "shelf", "pieces")) for grp, t in table.groupby("grp")}


def _local_bounds(
    distinct: DataFrame, shelved: DataFrame, pivots: np.ndarray, table: pd.DataFrame, take: int, rows: int
) -> DataFrame:
    """``distinct`` with an upper bound of each query's ``take``-th distance, from its cell in one shelf."""
    cells = _cell_arrays(table)

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["grp"].isin(cells)]
            if not len(batch):
                continue
            d = _distances(_stack(batch["vec"]), pivots)
            cell = np.empty(len(batch), dtype="int32")
            shelf = np.empty(len(batch), dtype="int32")
            for r, (grp, digest) in enumerate(zip(batch["grp"], batch["digest"])):
                own, _, first, pieces = cells[grp]
                best = d[r, own].argmin()
                cell[r] = own[best]
                shelf[r] = first[best] + int(digest[:8], 16) % int(pieces[best])
            yield batch.assign(cells=[[c] for c in cell], shelf=shelf)

    kind = "grp string, digest string, vec array<double>, cells array<int>, shelf int"
    at_home = distinct.select("grp", "digest", "vec").mapInPandas(home, kind).withColumn("bound", F.lit(float("inf")))
    return _shelf_join(at_home, shelved, ["shelf"], take, rows, _ask_listed, bounds_only=True)


def _visits(distinct: DataFrame, pivots: np.ndarray, table: pd.DataFrame, rows: int | None = None) -> DataFrame:
    """One row per query and shelf that may hold one of its neighbours.

    The shelves of a query are found as a list, so that its vector is copied
    only on the way to the tasks.
    """
    if "shelf" not in table:
        table = _on_shelves(table, rows or side_rows(distinct))
    cells = _cell_arrays(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["grp"].isin(cells)].reset_index(drop=True)
            if not len(batch):
                continue
            d = _distances(_stack(batch["vec"]), pivots)
            lists: list = [None] * len(batch)
            for grp, at in batch.groupby("grp").indices.items():
                cell, radius, first, pieces = cells[grp]
                slack = 1e-7 * (1.0 + d[at].max())
                near = d[np.ix_(at, cell)] - radius[None, :] <= batch["bound"].to_numpy()[at][:, None] * (1.0 + 1e-9) + slack
                start = first.min()
                seen = np.zeros((len(at), int((first + pieces).max() - start)), dtype=bool)
                for c in range(len(cell)):
                    seen[:, first[c] - start : first[c] + pieces[c] - start] |= near[:, [c]]
                for r, row in zip(at, seen, strict=True):
                    lists[r] = (np.flatnonzero(row) + start).astype("int32")
            yield batch.assign(shelves=lists)

    kind = "grp string, digest string, vec array<double>, bound double, shelves array<int>"
    listed = materialize(distinct.select("grp", "digest", "vec", "bound").mapInPandas(run, kind), "visits")
    return listed.withColumn("shelf", F.explode("shelves")).drop("shelves")


def knn_classify(
    queries: DataFrame, train: DataFrame, key: str, vector: str, label: str, k: int = 7, exclude_self: bool = False,
    **options,
) -> DataFrame:
    """Majority label of the ``k`` nearest training rows; a tie takes the smaller label.

    ``votes`` holds the label counts, the basis of class probabilities.
    """
    near = nearest(queries, train, key, vector, k, payload=label, exclude_self=exclude_self, **options)
    labels = F.transform("neighbors", lambda n: n["payload"])
    votes = F.transform(
        F.array_distinct(labels),
        lambda c: F.struct((-F.size(F.filter(labels, lambda x: x == c))).alias("minus"), c.alias("label")),
    )
    ranked = F.array_sort(votes)
    return near.select(
        key,
        F.try_element_at(ranked, F.lit(1)).getField("label").alias("prediction"),
        F.transform(ranked, lambda v: F.struct(v["label"].alias("label"), (-v["minus"]).alias("votes"))).alias("votes"),
    )
