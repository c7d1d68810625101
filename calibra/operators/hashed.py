"""Approximate nearest neighbours by random-projection hash tables.

A table is a binary tree of the space. All nodes of a level share a random
direction, and a node splits at the median of its part of a bounded sample, so
leaves are even whatever the data looks like. The points lie in one leaf of
every table; a group of points uses as many levels as its size asks for, and
the leaves below one node fill a shelf. A query follows the tree and, where it lies
close to a split, the other side too: its leaves are the ``probes`` with the
least sum of squared distances to the splits crossed. It travels once to a shelf
that holds some of them, with the greatest of these sums, and the shelf's task
finds the leaves by it, so no list of leaves is moved or kept. Distances to all
points of these leaves are exact, so only a neighbour in no visited leaf is missed.

The number of probes is not guessed. A bounded sample of the queries is also
searched exactly, and the probes are doubled until the leaves of the asked share
of its neighbours are visited; with every leaf probed the search is exact, so
the share is always reached on the sample, and one table is enough.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibra.operators.neighbors import _exact, _Nearest, _shelf_join, _stack, side_rows
from calibra.session import checked_side, materialize

TABLES = 4
SAMPLE = 16_384  # points that the splits come from
LEVELS = 12  # at most; a leaf has some sample points
JUDGED = 200  # queries that are also searched exactly
FIRST_PROBES = 2
LEAF_BITS = 20
LEAVES_AT_ONCE = 1 << 20  # leaves of all queries that a task looks at together


@dataclass
class Table:
    """One tree: a direction per level, a threshold per node (node 1 is the root)."""

    directions: np.ndarray
    thresholds: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, levels: int, seed: int) -> Table:
        draw = np.random.default_rng(seed)
        directions = draw.normal(size=(levels, sample.shape[1]))
        thresholds, node = np.zeros(1 << max(1, levels)), np.ones(len(sample), np.int64)
        for level in range(levels):
            along = sample @ directions[level]
            order = np.lexsort((along, node))
            nodes, first, count = np.unique(node[order], return_index=True, return_counts=True)
            thresholds[nodes] = along[order][first + count // 2]
            node = 2 * node + (along >= thresholds[node])
        return cls(directions, thresholds)

    def leaves(self, v: np.ndarray, depth: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``v`` and leaves: the nearest leaf of every row, and the next ``probes - 1``.

        A leaf is a node of the row's own depth.
        """
        along = v @ self.directions.T if len(self.directions) else np.zeros((len(v), 0))
        row, node, cost = np.arange(len(v)), np.ones(len(v), np.int64), np.zeros(len(v))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for level in range(len(self.directions) + 1):
            ends = depth[row] <= level
            done.append((row[ends], node[ends]))
            row, node, cost = row[~ends], node[~ends], cost[~ends]
            if not len(row):
                break
            gap = along[row, level] - self.thresholds[node]
            near = 2 * node + (gap >= 0)
            if probes == 1:
                node = near
                continue
            row, node, cost = np.concatenate([row, row]), np.concatenate([near, near ^ 1]), np.concatenate([cost, cost + gap * gap])
            order = np.lexsort((cost, row))
            row, node, cost = row[order], node[order], cost[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < probes
            row, node, cost = row[kept], node[kept], cost[kept]
        return np.concatenate([r for r, _ in done]), np.concatenate([n for _, n in done])

    def along(self, v: np.ndarray) -> np.ndarray:
        return v @ self.directions.T if len(self.directions) else np.zeros((len(v), 0))

    def below(self, cost: np.ndarray, along: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The costs of both children of ``nodes``: the far one adds its squared distance to the split."""
        gap = along - self.thresholds[nodes]
        return cost + np.maximum(gap, 0.0) ** 2, cost + np.minimum(gap, 0.0) ** 2

    def costs(self, v: np.ndarray, levels: list[int]) -> list[np.ndarray]:
        """For each of the ``levels`` the costs of all its nodes, a row for each row of ``v``."""
        along, cost, found = self.along(v), np.zeros((len(v), 1)), {}
        for level in range(max(levels) + 1):
            if level in levels:
                found[level] = cost
            if level < max(levels):
                nodes = np.arange(1 << level, 2 << level)
                cost = np.stack(self.below(cost, along[:, [level]], nodes), axis=2).reshape(len(v), -1)
        return [found[level] for level in levels]


def _own_leaves(tables: list[Table], v: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places in ``v``, the leaf of every table in which a row lies, and nothing more to cross."""
    found = [(row, (no << LEAF_BITS) + leaf, np.zeros(len(row))) for no, table in enumerate(tables) for row, leaf in [table.leaves(v, depth, 1)]]
    return tuple(np.concatenate(column) for column in zip(*found, strict=True))


def _reached(tables: list[Table], v: np.ndarray, depth: np.ndarray, up: np.ndarray, probes: int) -> tuple[np.ndarray, ...]:
    """Places in ``v``, the nodes ``up`` levels above the leaves that hold a probed leaf, and the cost of the last one probed.

    A node costs no more than its leaves. Where every leaf is probed the first
    table has all points.
    """
    found = []
    for d, u in set(zip(depth.tolist(), up.tolist(), strict=True)):
        at = np.flatnonzero((depth == d) & (up == u))
        whole = probes >= 1 << d
        for no, table in enumerate(tables[:1] if whole else tables):
            leaf, node = table.costs(v[at], [d, d - u])
            cut = np.full(len(at), np.inf) if whole else np.partition(leaf, probes - 1, axis=1)[:, probes - 1] * (1.0 + 1e-9)
            row, place = np.nonzero(node <= cut[:, None])
            found.append((at[row], (no << LEAF_BITS) + (1 << (d - u)) + place, cut[row]))
    return tuple(np.concatenate(column) for column in zip(*found, strict=True))


def _cells(df: DataFrame, tables: list[Table], probes: int, keep: list[str]) -> DataFrame:
    """``keep``, ``cells`` and ``cuts``: nodes of all tables in one list, and the cost up to which leaves below them are probed.

    ``df`` has ``vec``, ``depth`` and ``up``. One probe is the row's own leaf,
    more are given as the nodes ``up`` levels above.
    """
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, LEAVES_AT_ONCE >> len(tables[0].directions))
        for whole in batches:
            for start in range(0, len(whole), step):
                batch = whole.iloc[start : start + step]
                v, depth = _stack(batch["vec"]), batch["depth"].to_numpy()
                row, node, cut = _own_leaves(tables, v, depth) if probes == 1 else _reached(tables, v, depth, batch["up"].to_numpy(), probes)
                order = np.argsort(row, kind="stable")
                ends = np.cumsum(np.bincount(row, minlength=len(batch)))[:-1]
                lists = [np.array([*np.split(c[order], ends), None], dtype=object)[:-1] for c in (node.astype("int32"), cut)]
                yield batch[keep].assign(cells=lists[0], cuts=lists[1])

    return df.mapInPandas(run, f"{kinds}, cells array<int>, cuts array<double>")


def _ask_reached(tables: list[Table]) -> Callable:
    """For the running leaves of a shelf, the queries whose ``cut`` is not below the leaf's cost."""

    def ask(left: pa.Table) -> Callable:
        cut = left.column("cut").to_numpy()
        path: list[tuple[int, np.ndarray]] = []  # nodes from the root, with their costs
        shelf: dict[int, np.ndarray] = {}  # its table

        def visitors(near: _Nearest, cell: int) -> np.ndarray:
            no, leaf = cell >> LEAF_BITS, cell & ((1 << LEAF_BITS) - 1)
            if no not in shelf:
                shelf[no] = tables[no].along(near.queries)
                path[:] = [(1, np.zeros(len(cut)))]
            depth = leaf.bit_length() - 1
            while path[-1][0] != leaf >> (depth - len(path) + 1):
                path.pop()
            while len(path) <= depth:
                node, cost = path[-1]
                child = leaf >> (depth - len(path))
                both = tables[no].below(cost, shelf[no][:, len(path) - 1], np.array([node]))
                path.append((child, both[child & 1]))
            return np.flatnonzero(path[-1][1] <= cut)

        return visitors

    return ask


def _above(cell: Column, up: Column) -> Column:
    """The shelf of a leaf: the node ``up`` levels above it."""
    table = F.shiftleft(F.shiftright(cell, LEAF_BITS), LEAF_BITS)
    return table + F.call_function("shiftright", cell.bitwiseAND(F.lit((1 << LEAF_BITS) - 1)), up)


def hashed_pairs(
    distinct: DataFrame, points: DataFrame, take: int, block: int, recall: float, tables: int = TABLES, judged: int = JUDGED,
) -> DataFrame:
    """Rows ``(grp, digest, near, low, distance)`` with the nearest vectors the tables find for every query vector.

    ``distinct`` has ``(grp, digest, vec)`` of the queries, ``points`` also
    ``low``, the least id of a vector.
    """
    if not 0 < recall <= 1:
        raise ValueError("the asked share of neighbours must lie between 0 and 1")
    plain = points.select("grp", "digest", "vec", "low")
    size = F.greatest(F.ceil(F.log2(F.count(F.lit(1)) / block)), F.lit(0))
    rows = side_rows(plain)
    top = F.greatest(F.ceil(F.log2(F.count(F.lit(1)) / rows)), F.lit(0))  # levels above the shelves
    depth = F.least(size, F.lit(LEVELS)).cast("int")
    depths = checked_side(plain.groupBy("grp").agg(depth.alias("depth"), F.greatest(depth - top, F.lit(0)).cast("int").alias("up")), "depths")
    levels = int(depths.agg(F.max("depth")).first()[0])
    sample = _stack(plain.orderBy(F.md5("digest"), "grp").limit(SAMPLE).select("vec").toPandas()["vec"])
    trees = [Table.fit(sample, levels, seed) for seed in range(tables if levels else 1)]
    probes = FIRST_PROBES
    if levels:
        asked = materialize(distinct.orderBy(F.md5("digest"), "grp").limit(judged), "judged")
        true = _true_leaves(asked, plain, _exact(asked, points, take, block, 1), depths, take)
        while probes < 1 << levels and _share_found(trees, true, probes) < recall:
            probes *= 2
    if probes >= 1 << levels:
        probes, trees = 1 << levels, trees[:1]  # every leaf of one table: the others hold the same points

    keep = ["grp", "digest", "vec", "low", "up"]
    placed = _cells(plain.join(depths, "grp"), trees, 1, keep).withColumn("cell", F.explode("cells")).drop("cells", "cuts")
    placed = materialize(placed, "leaves")
    placed = placed.withColumn("shelf", _above(F.col("cell"), F.col("up"))).drop("up")
    filled = placed.groupBy("grp", "shelf").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("pieces"))
    known = checked_side(filled, "shelf-sizes")
    salted = placed.join(known, ["grp", "shelf"]).withColumn("salt", F.pmod(F.xxhash64("digest"), F.col("pieces")).cast("int"))
    listed = materialize(_cells(distinct.join(depths, "grp"), trees, probes, ["grp", "digest", "vec"]), "visits")
    visits = listed.select("grp", "digest", "vec", F.inline(F.arrays_zip(F.col("cells").alias("shelf"), F.col("cuts").alias("cut"))))
    visits = visits.join(known, ["grp", "shelf"])
    visits = visits.withColumns({"salt": F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)), "bound": F.lit(float("inf"))})
    found = _shelf_join(visits, salted, ["grp", "shelf", "salt"], take, rows, _ask_reached(trees))
    return found.dropDuplicates(["grp", "digest", "near"])  # a neighbour can be in the leaves of several tables


def _true_leaves(asked: DataFrame, plain: DataFrame, true: DataFrame, depths: DataFrame, take: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of the judged queries and of their nearest, a pair a row, and the depth of their group.

    At most ``take`` pairs for each judged query.
    """
    best = Window.partitionBy("grp", "digest").orderBy("distance", "low")
    pairs = true.withColumn("__rn", F.row_number().over(best)).filter(F.col("__rn") <= take).select("grp", "digest", "near")
    ends = plain.select("grp", F.col("digest").alias("near"), F.col("vec").alias("end"))
    table = pairs.join(asked, ["grp", "digest"]).join(ends, ["grp", "near"]).join(depths, "grp").select("vec", "end", "depth").toPandas()
    if table.empty:
        return np.zeros((0, 1)), np.zeros((0, 1)), np.zeros(0, np.int64)
    return _stack(table["vec"]), _stack(table["end"]), table["depth"].to_numpy()


def _share_found(trees: list[Table], true: tuple[np.ndarray, np.ndarray, np.ndarray], probes: int) -> float:
    """Share of the pairs whose end lies in a leaf that its query visits."""
    starts, ends, depth = true
    if not len(depth):
        return 1.0
    found = np.zeros(len(depth), dtype=bool)
    for tree in trees:
        own = np.zeros(len(depth), np.int64)
        at, leaf = tree.leaves(ends, depth, 1)
        own[at] = leaf
        row, leaf = tree.leaves(starts, depth, probes)
        found[row[leaf == own[row]]] = True
    return float(found.mean())
