"""Near-duplicate join of documents by the Jaccard similarity of word n-grams.

A text is the set of its runs of ``n`` words (a shorter text is one run). An
LSH forest finds candidates: every tree orders the texts by a MinHash label, so
texts that share a prefix of the label are a node of the tree's prefix trie.
Matching starts at the full label and the prefix is shortened until a pair
right at the threshold is found by some tree with the target probability;
pairs above the threshold are found more surely. The nodes at that depth are
then verified exactly: intersections are counted on the whole sets.

Scale. Copies of a text are one text with a number of copies. Only keys travel
until the nodes with several texts are known; sets are made again for texts in
such nodes alone. A node with the same texts as another tree's is verified
once. A large node is cut into blocks and verified block against block in
different tasks. A task returns link counts and a spanning forest, never the
pairs, and a pair counts in the first tree that has it.

Defined results: a null or empty text, or one of white space, has no set and
no links and is a class of its own, but copies of it are not linked; the class
of a document is the least document id in its connected group (null only if
all are null); rows alike count as copies; an empty input gives no rows. Sets
hold 64-bit hashes of the runs, and copies are told by two 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.llm.common import fresh_names, materialize
from calibra.session import small_side

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 16, 8, 0.999
BLOCK = 512  # texts of one side of a verification
CACHE_WORDS = 600_000

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold is found with the wanted probability."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


class Shingler:
    """Sets of word runs, and the prefixes of their labels."""

    def __init__(self, words: int, trees: int, depth: int, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.n, self.trees, self.depth = words, trees, depth
        self.places = draw.integers(1, 1 << 63, words, dtype=np.uint64) | np.uint64(1)
        self.factors = draw.integers(1, 1 << 32, trees * depth, dtype=np.uint32) | np.uint32(1)
        self.shifts = draw.integers(0, 1 << 32, trees * depth, dtype=np.uint32)
        self.known: dict[bytes, int] = {}

    def runs(self, raw: bytes | None) -> np.ndarray:
        """The sorted distinct hashes of the runs of a text."""
        import xxhash

        words = (raw or b"").split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = min(self.n, len(h))
        total = np.zeros(len(h) - size + 1, np.uint64)
        for k in range(size):
            total += mix(h[k : len(h) - size + 1 + k] * self.places[k])
        return np.unique(mix(total + np.uint64(size)))

    def prefixes(self, runs: np.ndarray) -> np.ndarray:
        """One value per tree: the first ``depth`` minima of its label."""
        x = (runs >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.factors), np.uint32(0xFFFFFFFF))
        for lo in range(0, len(x), 4096):
            low = np.minimum(low, (x[lo : lo + 4096, None] * self.factors + self.shifts).min(axis=0))
        labels = low.reshape(self.trees, self.depth).astype(np.uint64)
        out = np.arange(self.trees, dtype=np.uint64)
        for k in range(self.depth):
            out = mix(out * _MIX1 + labels[:, k] + np.uint64(1))
        return out.view(np.int64)


def jaccard_groups(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    threshold: float = THRESHOLD,
    trees: int = TREES,
    recall: float = RECALL,
) -> tuple[DataFrame, DataFrame]:
    """Classes and memberships.

    First: h1, h2 (the hashes of a text), least, copies, has_set, links,
    class_id, leads of every distinct text; ``links`` counts the other
    documents, copies too, at the threshold or above, and a class has one text
    that leads it. Second: key, h1, h2 of every row of ``docs``.
    """
    shingler = Shingler(words, trees, prefix_depth(threshold, trees, DEPTH, recall))
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(raw).alias("h1"), F.xxhash64(F.lit(1), raw).alias("h2"), raw.cast("binary").alias("raw"))
    texts = materialize(_labels(rows, shingler), "forest-texts")
    nodes = _nodes(texts)
    tasks = materialize(nodes, "forest-tasks")
    sets = _sets(rows, texts, tasks, shingler)
    found = materialize(_verify(sets, tasks, threshold), "forest-links")
    links = found.where("root is null").groupBy("no").agg(F.sum("links").alias("links"))
    groups = connected(found.where("root is not null").select(F.col("no").alias("a"), F.col("root").alias("b")))
    classes = texts.join(links, "no", "left").join(groups, "no", "left")
    classes = classes.withColumn("of", F.coalesce("of", "no"))
    # groups of one text need no shuffle by group: only members of larger groups look for the least id
    first = F.min(F.struct(F.col("least").isNull(), "least", "h1", "h2"))
    heads = classes.where("of != no or links is not null").groupBy("of").agg(first.alias("head"))
    classes = classes.join(heads, "of", "left")
    alone = F.col("head").isNull()
    own = F.when(F.col("n") > 0, F.col("copies") - 1).otherwise(0)
    return (
        classes.select(
            "h1",
            "h2",
            "least",
            "copies",
            (F.col("n") > 0).alias("has_set"),
            (F.coalesce("links", F.lit(0)) + own).cast("long").alias("links"),
            F.when(alone, F.col("least")).otherwise(F.col("head.least")).alias("class_id"),
            (alone | ((F.col("head.h1") == F.col("h1")) & (F.col("head.h2") == F.col("h2")))).alias("leads"),
        ),
        rows.select("key", "h1", "h2"),
    )


def _labels(rows: DataFrame, shingler: Shingler) -> DataFrame:
    """One row per distinct text: no, h1, h2, least, copies, n, prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prefixes = [], []
            for raw in batch.column(3).to_pylist():
                runs = shingler.runs(raw)
                sizes.append(len(runs))
                prefixes.append(shingler.prefixes(runs) if len(runs) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))],
                names=["key", "h1", "h2", "n", "prefixes"],
            )

    kind = rows.schema["key"].dataType.simpleString()
    labelled = rows.mapInArrow(run, f"key {kind}, h1 bigint, h2 bigint, n bigint, prefixes array<bigint>")
    grouped = labelled.groupBy("h1", "h2").agg(
        F.min("key").alias("least"),
        F.count(F.lit(1)).alias("copies"),
        F.max("n").alias("n"),
        F.max("prefixes").alias("prefixes"),
    )
    return grouped.withColumn("no", F.monotonically_increasing_id())


def _nodes(texts: DataFrame) -> DataFrame:
    """no, tree, prefix, bi, bj, side: the verifications that a text takes part in."""
    places = texts.select("no", F.posexplode("prefixes").alias("tree", "prefix"))
    nodes = (
        places.groupBy("tree", "prefix")
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.bit_xor(F.xxhash64("no")).alias("who1"),
            F.bit_xor(F.xxhash64(F.lit(1), "no")).alias("who2"),
        )
        .where("size > 1")
    )
    # the same texts under several trees: the first tree has them
    nodes = nodes.groupBy("size", "who1", "who2").agg(F.min(F.struct("tree", "prefix")).alias("at"))
    nodes = materialize(nodes.select("at.tree", "at.prefix", "size"), "forest-nodes")
    members = places.join(small_side(nodes, nodes.count()), ["tree", "prefix"])
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    members = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("no"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return members.select("no", "tree", "prefix", "block", other).select(
        "no",
        "tree",
        "prefix",
        F.least("block", "other").alias("bi"),
        F.greatest("block", "other").alias("bj"),
        F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"),
    )


def _sets(rows: DataFrame, texts: DataFrame, tasks: DataFrame, shingler: Shingler) -> DataFrame:
    """no, copies, prefixes, runs of the texts that have a verification."""
    wanted = materialize(
        texts.join(tasks.select("no").distinct(), "no").select("no", "h1", "h2", "least", "copies", "prefixes"), "forest-wanted"
    )
    wanted = wanted.withColumnsRenamed({"h1": "w1", "h2": "w2"})
    same = (
        (F.col("h1") == F.col("w1"))
        & (F.col("h2") == F.col("w2"))
        & F.col("key").eqNullSafe(F.col("least"))  # one of the copies
    )
    found = rows.join(small_side(wanted, wanted.count()), same).select("no", "copies", "prefixes", "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [shingler.runs(raw).tobytes() for raw in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(runs, pa.binary())], names=["no", "copies", "prefixes", "runs"]
            )

    sets = found.mapInArrow(run, "no bigint, copies bigint, prefixes array<bigint>, runs binary")
    return sets.dropDuplicates(["no"])  # rows alike


def _verify(sets: DataFrame, tasks: DataFrame, threshold: float) -> DataFrame:
    """no, links, root: link counts of the tasks (root null) and edges of spanning forests (links null)."""
    at = ["tree", "prefix", "bi", "bj"]
    rows = tasks.join(sets, "no").select(*at, "side", "no", "copies", "prefixes", "runs")
    rows = rows.repartition(*at).sortWithinPartitions(*at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None
        for batch in batches:
            out = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[:4] != now:
                    if held:
                        out.append(_links(now, held, threshold))
                    now, held = row[:4], []
                held.append(row[4:])
            if out:
                yield _table(out)
        if held:
            yield _table([_links(now, held, threshold)])

    return rows.mapInArrow(run, "no bigint, links bigint, root bigint")


def _table(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    who, links, child, root = (np.concatenate(x) for x in zip(*parts, strict=True))
    none = [None] * len(child)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([who, child])),
            pa.concat_arrays([pa.array(links, pa.int64()), pa.array(none, pa.int64())]),
            pa.concat_arrays([pa.array([None] * len(who), pa.int64()), pa.array(root, pa.int64())]),
        ],
        names=["no", "links", "root"],
    )


def _links(at: tuple, rows: list[tuple], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Verify all pairs of a block, or of two blocks, that no earlier tree has."""
    tree, _prefix, bi, bj = at
    side = np.array([r[0] for r in rows])
    no = np.array([r[1] for r in rows], np.int64)
    copies = np.array([r[2] for r in rows], np.int64)
    sets = [np.frombuffer(r[4], np.uint64) for r in rows]
    sizes = np.array([len(s) for s in sets], np.int64)
    common = _intersections(sets)
    linked = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
    np.fill_diagonal(linked, False)
    if bi != bj:
        linked &= side[:, None] != side[None, :]
    if tree:
        earlier = np.array([r[3][:tree] for r in rows], np.int64)
        for k in range(tree):
            linked &= earlier[:, k][:, None] != earlier[:, k][None, :]
    links = linked @ copies
    some = links > 0
    root = np.arange(len(no))
    while True:  # the least position that a text reaches
        near = np.where(linked, root[None, :], len(no)).min(axis=1, initial=len(no))
        lower = np.minimum(root, near)
        lower = lower[lower]
        if (lower == root).all():
            break
        root = lower
    child = root != np.arange(len(no))
    return no[some], links[some], no[child], no[root[child]]


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairwise intersections, from the runs that several sets have."""
    m = len(sets)
    out = np.zeros((m, m), np.float32 if max(map(len, sets)) < 1 << 24 else np.float64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, bool)
    place = np.cumsum(new) - 1
    several = np.bincount(place, minlength=1)[place] > 1 if len(flat) else np.zeros(0, bool)
    owner, place = owner[several], place[several]
    if len(place):
        place = np.unique(place, return_inverse=True)[1]
        for lo in range(0, place[-1] + 1, 4096):
            a, b = np.searchsorted(place, [lo, lo + 4096])
            part = np.zeros((m, min(4096, place[-1] + 1 - lo)), out.dtype)
            part[owner[a:b], place[a:b] - lo] = 1
            out += part @ part.T
    return out.astype(np.int64)


def connected(edges: DataFrame) -> DataFrame:
    """no, of: for every node of ``edges`` (a, b) the least node that it reaches.

    Each round takes the least label around a node and then the label of that
    label, so chains shorten by halves. Every round is a written table.
    """
    both = materialize(edges.union(edges.select("b", "a")).distinct().toDF("no", "near"), "edges")
    label = materialize(both.groupBy("no").agg(F.least("no", F.min("near")).alias("of")), "labels")
    while True:
        around = both.join(label.select(F.col("no").alias("near"), F.col("of").alias("seen")), "near")
        lower = around.groupBy("no").agg(F.min("seen").alias("seen"))
        lower = label.join(lower, "no").select("no", F.least("of", "seen").alias("next"), F.col("of").alias("old"))
        jump = label.select(F.col("no").alias("next"), F.col("of").alias("jumped"))
        moved = lower.join(jump, "next", "left").select("no", F.least("next", "jumped").alias("of"), "old")
        moved = materialize(moved, "labels")
        label = moved.select("no", "of")
        if moved.where("of != old").isEmpty():
            return label


def jaccard_rows(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links of every document."""
    classes, rows = jaccard_groups(docs)
    classes = classes.withColumnsRenamed({"h1": "c1", "h2": "c2"})
    joined = rows.join(classes, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")))
    own = F.when(F.col("has_set"), F.col("class_id")).otherwise(F.col("key"))
    return joined.select(F.col("key").alias("doc_id"), own.alias("class_id"), F.col("links").alias("n_links"))


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of every class: the one with the least id.

    Texts without a set all stay; of rows alike in id and text one stays.
    """
    classes, _ = jaccard_groups(docs, key=key, text=text)
    shared = classes.where("has_set and (copies > 1 or not leads)").select("h1", "h2", "least", "leads")
    shared = materialize(shared, "forest-shared")
    new = fresh_names(docs, *shared.columns, "t1", "t2")
    shared = shared.select(*[F.col(c).alias(new[c]) for c in shared.columns])
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumns({new["t1"]: F.xxhash64(raw), new["t2"]: F.xxhash64(F.lit(1), raw)})
    same = (F.col(new["t1"]) == F.col(new["h1"])) & (F.col(new["t2"]) == F.col(new["h2"]))
    side = small_side(shared, shared.count())
    others = rows.join(side, same, "left_anti")
    heads = rows.join(side, same & F.col(new["leads"]) & F.col(key).eqNullSafe(F.col(new["least"])), "left_semi")
    return others.unionByName(heads.dropDuplicates([new["t1"], new["t2"]])).select(*docs.columns)
