"""Benchmark decontamination by spaced seeds.

A seed is a mask over a short run of words: the words at its ones are hashed,
the words at its zeros may be anything. Seeds of all benchmark items and of all
positions of all texts are joined on their hash. A hit fixes how text and item
lie against each other; there the words are compared one by one, and a run of
``WINDOW`` words of which ``SAME`` agree is an overlap. The masks are chosen so
that every pattern of replaced words the count tolerates leaves a hit of one of
them, so no overlap is lost before the comparison.

Words are runs of letters and digits in lower case. Only hashes of words
travel. A long text is cut into segments that overlap by a mask's length, so
no row grows with the text. Benchmark seeds are broadcast when their counted
number is small, and joined by a shuffle otherwise.

Defined results: null and empty texts and items have no words and no overlap;
an item shorter than ``WINDOW`` must agree to four fifths and is looked for by
the masks of its length, from ``LEAST`` words on; items with fewer words are
not looked for; copies of a text all have its overlaps; a repeated item id
names several items; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.llm.common import fresh_names, materialize
from calibra.session import small_side

WINDOW, SAME = 13, 10
LEAST = 5
#: By the words of an item, ``WINDOW`` for all longer ones: words that count (1) and words that are ignored (0).
#: For every choice of replaced words that the law tolerates, some mask hits at some place; a test counts them all.
MASKS = {
    5: ("1111", "11101", "11011", "10111"),
    6: ("1111", "11011"),
    7: ("11011",),
    8: ("111011", "11111"),
    9: ("111011",),
    10: ("111011", "11010011", "11111"),
    11: ("1101011", "1110011"),
    12: ("11101011", "101100111", "111111"),
    13: ("1110111", "11100001011", "11011011", "1101000111", "1110000111"),
}
SEGMENT = 512  # positions of a segment


def word_hashes(text: Column) -> Column:
    """The hashes of the words of a text, in order."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seeds(rows: DataFrame, words: str, keep: list[str], masks: list[str]) -> DataFrame:
    """``keep``, place, mask, seed: the hash of every mask at every place of the array ``words``."""
    count, span = F.size(words), max(map(len, masks), default=1)
    starts = F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)), F.lit(SEGMENT))
    cut = F.transform(starts, lambda s: F.struct(s.alias("at"), F.slice(words, s + 1, SEGMENT + span - 1).alias("w")))
    parts = rows.where(count > 0).select(*keep, F.inline(cut))
    length = F.size("w")
    shifted = [F.slice("w", k + 1, F.greatest(F.least(length - k, F.lit(SEGMENT)), F.lit(0))).alias(f"w{k}") for k in range(span)]
    zipped = parts.select(*keep, "at", F.posexplode(F.arrays_zip(*shifted)).alias("i", "z"))
    zipped = zipped.where("z.w0 is not null")
    found = []
    for mask in masks:
        used = [F.col(f"z.w{k}") for k, bit in enumerate(mask) if bit == "1"]
        found.append(F.when(F.col(f"z.w{len(mask) - 1}").isNotNull(), F.xxhash64(F.lit(mask), *used)))
    place = (F.col("at") + F.col("i")).alias("place")
    seeds = F.posexplode(F.array(*found) if found else F.expr("cast(array() as array<bigint>)")).alias("mask", "seed")
    return zipped.select(*keep, place, seeds).where("seed is not null")


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """h1, h2 (the hashes of a text), item, place, n_words, n_same: every overlap, once for all copies.

    ``place`` is the position in the text, in words from 0, of the item's first
    word, and may be negative; ``n_same`` of the item's ``n_words`` agree.
    """
    items = benchmark.select(F.col(item).alias("item"), word_hashes(F.col(item_text)).alias("item_words"))
    items = items.where(F.size("item_words") >= LEAST).withColumn("item_no", F.xxhash64("item_words")).distinct()
    items = materialize(items, "bench-items")
    count = items.count()
    class_of = F.least(F.size("item_words"), F.lit(WINDOW))
    lengths = [r["n"] for r in items.select(class_of.alias("n")).distinct().collect()]  # at most WINDOW - LEAST + 1 values
    masks = sorted({m for n in lengths for m in MASKS[n]})
    own = F.create_map(*[x for n in MASKS for x in (F.lit(n), F.array(*[F.lit(m in MASKS[n]) for m in masks]).cast("array<boolean>"))])
    bench = _seeds(items.withColumn("own", own[class_of]), "item_words", ["item", "item_no", "own"], masks)
    bench = bench.where(F.get("own", "mask"))  # an item is looked for by the masks of its length only
    bench = materialize(bench.select("item", "item_no", "seed", F.col("place").alias("item_place")), "bench-seeds")

    rows = docs.select(*_text_keys(text), word_hashes(F.col(text)).alias("words"))
    seeds = _seeds(rows, "words", ["h1", "h2"], masks).drop("mask")
    hits = seeds.join(small_side(bench, bench.count()), "seed").select(
        "h1", "h2", "item", "item_no", (F.col("place") - F.col("item_place")).alias("place")
    )
    hits = materialize(hits.distinct(), "bench-hits")

    near = hits.join(small_side(items, count), ["item", "item_no"]).withColumnsRenamed({"h1": "c1", "h2": "c2"})
    near = materialize(near.drop("item_no"), "bench-candidates")
    same_text = (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2"))
    texts = rows.join(small_side(hits.select(F.col("h1").alias("k1"), F.col("h2").alias("k2")).distinct(), hits.count()),
                      (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left_semi")
    texts = materialize(texts.dropDuplicates(["h1", "h2"]), "bench-texts")
    pairs = texts.join(near, same_text)
    agree = F.expr("transform(item_words, (w, j) -> if(w <=> get(words, place + j), 1, 0))")
    pairs = pairs.select("h1", "h2", "item", "place", F.size("item_words").alias("n_words"), agree.alias("agree"))
    enough = F.expr(f"""
        if(n_words >= {WINDOW},
           exists(sequence(1, n_words - {WINDOW} + 1),
                  s -> aggregate(slice(agree, s, {WINDOW}), 0, (a, b) -> a + b) >= {SAME}),
           aggregate(agree, 0, (a, b) -> a + b) * 5 >= n_words * 4)
    """)
    total = F.expr("aggregate(agree, 0, (a, b) -> a + b)")
    return materialize(pairs.where(enough).select("h1", "h2", "item", "place", "n_words", total.alias("n_same")), "bench-overlaps")


def _text_keys(text: str, one: str = "h1", two: str = "h2") -> list[Column]:
    raw = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(raw).alias(one), F.xxhash64(F.lit(1), raw).alias(two)]


def overlap_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_words, n_same: each overlapping document and item, by their best alignment."""
    found = find_overlaps(docs, benchmark)
    best = found.groupBy("h1", "h2", "item").agg(F.max(F.struct("n_same", "n_words")).alias("best"))
    best = materialize(best.withColumnsRenamed({"h1": "c1", "h2": "c2"}), "bench-best")
    rows = docs.select("doc_id", *_text_keys("text"))
    joined = rows.join(small_side(best, best.count()), (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")))
    return joined.select("doc_id", F.col("item").alias("item_id"), "best.n_words", "best.n_same")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text") -> DataFrame:
    """The documents that overlap no benchmark item."""
    new = fresh_names(docs, "h1", "h2", "c1", "c2")
    bad = find_overlaps(docs, benchmark, text=text).select(F.col("h1").alias(new["c1"]), F.col("h2").alias(new["c2"])).distinct()
    bad = materialize(bad, "bench-bad")
    h1, h2 = _text_keys(text)
    rows = docs.withColumns({new["h1"]: h1, new["h2"]: h2})
    same = (F.col(new["h1"]) == F.col(new["c1"])) & (F.col(new["h2"]) == F.col(new["c2"]))
    return rows.join(small_side(bad, bad.count()), same, "left_anti").select(*docs.columns)
