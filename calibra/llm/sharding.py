"""Shards of near equal bytes from a k-d tree over document metadata.

The tree splits every node at a weighted median along its widest dimension
until each leaf holds its share of the bytes. A median is found by counting:
each pass adds up the bytes per slice of the key range of every open node and
narrows the range to the slice that holds the median, so no node is ever
sorted or gathered. Only the slice sums of a pass reach the driver; their
number is bounded by ``SLICE_ROWS``.

Dimensions are the size of the text and any number of categories. A category
has no order, so its place on the axis is a hash. Copies of a text share their
coordinates (the least of the group's), hence they lie together; a cut falls
between groups unless the group is large against a shard, and then inside it.

Defined results: a null text has no bytes and the checksum 0; a null category
is a category; rows alike in every column are told apart by a number given
when the narrow table is written; an empty input gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from calibra.llm.common import keep_columns, long_array, materialize

ROW_BYTES = 8  # added to each text
COORD_BITS, HASH_BITS, TIE_BITS = 20, 28, 48
KEY_BITS = COORD_BITS + HASH_BITS
SLICE_ROWS = 1 << 17  # slice sums that one pass may send to the driver
CHUNK_ROWS = 50_000  # rows that are numbered in one sort
GROUP_SHARE = 0.02  # a group of copies up to this share of a shard is not cut


def kd_shards(
    docs: DataFrame,
    shards: int | None = None,
    target_bytes: int | None = None,
    *,
    key: str = "doc_id",
    text: str = "text",
    categories: Sequence[str] = ("source", "lang"),
) -> DataFrame:
    """``key``, size, text_crc32, shard, slot of every row of ``docs``.

    Give the number of ``shards`` or the ``target_bytes`` of one. ``slot`` is
    gapless from 0 within a shard.
    """
    table = materialize(_narrow(docs, key, text, keep_columns(docs, categories)), "kd-rows")
    total, rows, largest = table.agg(F.sum("size"), F.count(F.lit(1)), F.max("size")).first()
    if shards is None:
        if not target_bytes:
            raise ValueError("give shards or target_bytes")
        shards = max(1, math.ceil((total or 0) / target_bytes))
    dims = [c for c in table.columns if c.startswith("dim")]
    table = table.withColumn("node", F.lit(0))
    sizes = [shards]  # leaves below each open node
    slack = max(largest or 0, GROUP_SHARE * (total or 0) / shards)
    while rows and max(sizes) > 1:
        table, sizes = _split(table, dims, sizes, slack)
    return _number(table.withColumnRenamed("node", "shard"), key, rows, shards)


def _narrow(docs: DataFrame, key: str, text: str, categories: Sequence[str]) -> DataFrame:
    """One short row per document: size, checksum, group of copies, coordinates."""
    content = F.coalesce(F.col(text), F.lit(""))
    size = (F.octet_length(content) + ROW_BYTES).cast("long")
    rows = docs.select(
        F.col(key).alias(key),
        size.alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        F.xxhash64(content).alias("copy_of"),
        F.monotonically_increasing_id().alias("row_no"),
        *[F.pmod(F.xxhash64(F.col(c)), F.lit(1 << COORD_BITS)).alias(f"place{i}") for i, c in enumerate(categories)],
    )
    rows = materialize(rows, "kd-narrow")  # fixes row_no
    places = [f"place{i}" for i in range(len(categories))]
    if places:
        group = rows.groupBy("copy_of", "size").agg(*[F.min(p).alias(f"least_{p}") for p in places])
        rows = rows.join(group, ["copy_of", "size"])
    along_size = F.least(F.log2(F.col("size")) / 40 * (1 << COORD_BITS), F.lit((1 << COORD_BITS) - 1)).cast("long")
    return rows.select(
        key,
        "size",
        "text_crc32",
        "row_no",
        F.shiftrightunsigned("copy_of", 64 - HASH_BITS).alias("copies"),
        F.shiftrightunsigned(F.xxhash64(F.col(key), F.col("row_no")), 64 - TIE_BITS).alias("tie"),
        along_size.alias("dim0"),
        *[F.col(f"least_{p}").alias(f"dim{i + 1}") for i, p in enumerate(places)],
    )


def _split(table: DataFrame, dims: list[str], sizes: list[int], slack: float) -> tuple[DataFrame, list[int]]:
    """One level of the tree: every node with several leaves is cut in two."""
    spans = {
        r["node"]: r
        for r in table.groupBy("node")
        .agg(F.sum("size").alias("bytes"), *[f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)])
        .collect()
    }
    root = [
        max(1, max(r[f"max_{d}"] for r in spans.values()) - min(r[f"min_{d}"] for r in spans.values())) for d in dims
    ]
    open_nodes = [n for n, leaves in enumerate(sizes) if leaves > 1 and n in spans]
    axis, quota = {}, {}
    for n in open_nodes:
        widths = [(spans[n][f"max_{d}"] - spans[n][f"min_{d}"]) / w for d, w in zip(dims, root, strict=True)]
        axis[n] = widths.index(max(widths))
        quota[n] = spans[n]["bytes"] * (sizes[n] // 2) / sizes[n]
    along = F.get(F.array(*dims), F.get(long_array(axis.get(n, 0) for n in range(len(sizes))), "node").cast("int"))
    keyed = table.withColumn("key", F.shiftleft(along, HASH_BITS).bitwiseOR(F.col("copies")))

    cuts, ties = {}, {}
    found = _median(keyed, "key", KEY_BITS, open_nodes, quota, len(sizes))
    inside = []
    for n in open_nodes:
        at, below, here = found[n]
        cuts[n] = at
        if here <= slack:
            ties[n] = 1 << TIE_BITS if quota[n] - below > here / 2 else 0
        else:
            inside.append(n)
            quota[n] -= below
    if inside:
        group = keyed.where(F.col("key") == F.get(long_array(cuts.get(n, -1) for n in range(len(sizes))), "node"))
        for n, (at, below, here) in _median(group, "tie", TIE_BITS, inside, quota, len(sizes)).items():
            ties[n] = at + 1 if quota[n] - below > here / 2 else at

    left_at, next_sizes = [], []
    for leaves in sizes:
        left_at.append(len(next_sizes))
        next_sizes += [leaves // 2, leaves - leaves // 2] if leaves > 1 else [leaves]
    cut = F.get(long_array(cuts.get(n, 0) for n in range(len(sizes))), "node")
    tie = F.get(long_array(ties.get(n, 0) for n in range(len(sizes))), "node")
    can = F.get(long_array(int(leaves > 1) for leaves in sizes), "node") == 1
    right = can & ((F.col("key") > cut) | ((F.col("key") == cut) & (F.col("tie") >= tie)))
    moved = keyed.withColumn("node", (F.get(long_array(left_at), "node") + right.cast("int")).cast("int"))
    return materialize(moved.drop("key"), "kd-level"), next_sizes


def _median(
    rows: DataFrame, key: str, bits: int, nodes: list[int], quota: dict[int, float], width: int
) -> dict[int, tuple[int, int, int]]:
    """By node: the key at which the running bytes reach the quota, the bytes below it and at it."""
    step = max(1, min(12, int(math.log2(SLICE_ROWS // max(1, len(nodes))))))
    prefix, below = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    here: dict[int, int] = dict.fromkeys(nodes, 0)
    done = 0
    while done < bits:
        take = min(step, bits - done)
        fits = F.get(long_array(prefix.get(n, -1) for n in range(width)), "node")
        counted = (
            rows.where(F.shiftright(key, bits - done) == fits)
            .groupBy("node", F.shiftright(key, bits - done - take).alias("slice"))
            .agg(F.sum("size").alias("bytes"))
        )
        sums: dict[int, list[tuple[int, int]]] = {n: [] for n in nodes}
        for r in counted.collect():
            sums[r["node"]].append((r["slice"], r["bytes"]))
        for n in nodes:
            for at, size in sorted(sums[n]):
                prefix[n], here[n] = at, size
                if below[n] + size >= quota[n]:
                    break
                below[n] += size
            else:  # the quota is all there is: the last slice holds it
                below[n] -= here[n]
        done += take
    return {n: (prefix[n], below[n], here[n]) for n in nodes}


def _number(rows: DataFrame, key: str, count: int, shards: int) -> DataFrame:
    """Gapless slots: places within chunks of a shard plus the rows of the chunks before."""
    chunks = max(1, math.ceil(count / max(1, shards) / CHUNK_ROWS))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("row_no"), F.lit(chunks)).cast("int"))
    before = W.partitionBy("shard").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        rows.groupBy("shard", "chunk")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    place = F.row_number().over(W.partitionBy("shard", "chunk").orderBy(key, "row_no")) - 1
    return (
        rows.withColumn("place", place)
        .join(starts, ["shard", "chunk"])
        .select(key, "size", "text_crc32", F.col("shard").cast("int"), (F.col("start") + F.col("place")).alias("slot"))
    )


def shard_rows(docs: DataFrame, shards: int = 24) -> DataFrame:
    """The digest of :func:`kd_shards` that the registered query returns."""
    law: Column = F.lit("bytes")
    out = kd_shards(docs, shards)
    return out.select(
        "doc_id", "size", "text_crc32", law.alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
