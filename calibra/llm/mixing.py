"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target share of all words: its weight's share, at most
``cap`` times what it has, the excess shared again by weight. A document of a
source with target t and size s is wanted t/s times: the whole part is certain,
the fractional part is a probability. Pivotal rounding turns these
probabilities into 0 or 1. Two documents meet and words of probability move
from one to the other, in a random direction that keeps both expectations,
until one of them is settled; the other one goes on to the next meeting. The
expected words of a source stay the same in every step, so what a source gives
differs from its target by less than one document.

The meetings form a reduction tree: documents of a source are dealt into small
chunks by a hash, a chunk is folded to one unsettled document, and these are
dealt into chunks again. All draws are hashes, so reruns agree.

Defined results: a null text has size 0; sources stand in code point order,
null last, and null is a source; a document of size 0 has no words to take; of n
rows alike in key, source and size, each with probability p, floor(n * p) get
the extra copy for certain and the rest of one row goes into the tree (which of
them get it follows the order they are read in); an empty input gives an empty
result.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibra.llm.common import WORD, fresh_names, materialize, unit
from calibra.operators.ordering import sorted_index

CHUNK = 128  # documents that meet in one fold, on average
BLOCK = 4096  # numbers of rows that are ranked together
SPLIT = "extra > 0 and extra < n"  # of rows alike some get the extra copy


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """``source``, source_size, target from a table of ``source`` and its ``source_size``."""
    last = F.col("source").isNull().alias("last")
    ranked, _ = sorted_index(sizes.select(last, "source", "source_size"), ["last", "source", "source_size"], "place")
    weight = F.get(F.array(*[F.lit(int(w)) for w in weights]), F.pmod("place", F.lit(len(weights))).cast("int"))
    table = materialize(ranked.select("source", "source_size", weight.cast("long").alias("weight")), "mix-weights")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while total:  # the level per weight rises until no further source is full
        over = F.col("weight") * F.lit(level) >= F.col("source_size") * cap
        n, taken, rest = table.agg(
            F.count_if(over),
            F.sum(F.when(over, F.col("source_size") * cap).otherwise(0)),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))),
        ).first()
        if n == full:
            break
        full, level = n, (total - taken) / rest
    target = F.least(F.col("weight") * F.lit(level), F.col("source_size") * F.lit(float(cap)))
    return table.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    cap: int = 3,
    *,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    seed: int = 7,
) -> DataFrame:
    """key, source, size, source_size, target, copies, taken of every row."""
    rows = _narrow(docs, key, source, text)
    decided = _decide(rows, weights, cap, seed)
    same = [F.col(f"u_{c}").eqNullSafe(F.col(c)) for c in ("key", "source", "size")]
    joined = rows.join(decided.where(f"not ({SPLIT})"), functools.reduce(operator.and_, same))
    joined = joined.withColumn("copies", F.col("whole") + (F.col("extra") > 0).cast("long"))
    split = decided.where(SPLIT)
    if not split.isEmpty():
        places = _places(rows.join(split, functools.reduce(operator.and_, same)), [f"u_{c}" for c in ("key", "source", "size")])
        joined = joined.unionByName(
            places.withColumn("copies", F.col("whole") + (F.col("place") < F.col("extra")).cast("long")), allowMissingColumns=True
        )
    return joined.select(
        "key", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def _narrow(docs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """key, source, size, row (a number of the row), written once."""
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(text).alias("size"))
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "mix-rows")


def _decide(rows: DataFrame, weights: Sequence[int], cap: int, seed: int) -> DataFrame:
    """u_key, u_source, u_size, n, source_size, target, whole, extra of the n rows alike: ``extra`` of them get one copy more."""
    units = rows.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    sizes = units.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = materialize(source_targets(sizes, weights, cap), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = units.withColumnRenamed("source", "of").join(targets, F.col("of").eqNullSafe(F.col("source"))).drop("of")
    units = units.withColumn("rate", rate).withColumn("whole", F.floor("rate"))
    units = units.withColumn("wanted", F.when(F.col("size") > 0, F.col("n") * (F.col("rate") - F.col("whole"))).otherwise(0.0))
    units = units.withColumn("certain", F.floor("wanted")).withColumn("p", F.col("wanted") - F.col("certain"))
    units = materialize(units.drop("wanted", "rate"), "mix-units")
    settled = _pivot(units.where("p > 0").select("key", "source", "size", F.col("size").alias("words"), "p"), seed)
    same = [F.col(f"s_{c}").eqNullSafe(F.col(c)) for c in ("key", "source", "size")]
    settled = settled.select(*[F.col(c).alias(f"s_{c}") for c in ("key", "source", "size")], "bit")
    extra = (F.col("certain") + F.coalesce(F.col("bit"), F.lit(0))).alias("extra")
    decided = units.join(settled, functools.reduce(operator.and_, same), "left")
    names = [F.col(c).alias(f"u_{c}") for c in ("key", "source", "size")]
    return materialize(decided.select(*names, "n", "source_size", "target", "whole", extra), "mix-decided")


def _places(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with their place, from 0, among the rows alike in ``names``, in the order of ``row``.

    Places inside blocks of ``BLOCK`` numbers and the counts of the blocks
    before them, so no task gets all rows of one group.
    """
    rows = rows.withColumn("block", F.floor(F.col("row") / F.lit(BLOCK)))
    blocks = rows.groupBy(*names, "block").agg(F.count(F.lit(1)).alias("held"))
    before = F.sum("held").over(Window.partitionBy(*names).orderBy("block")) - F.col("held")
    blocks = blocks.select(*[F.col(c).alias(f"b_{c}") for c in names], F.col("block").alias("b_block"), before.alias("before"))
    inside = F.row_number().over(Window.partitionBy(*names, "block").orderBy("row")) - 1
    same = [F.col(f"b_{c}").eqNullSafe(F.col(c)) for c in names] + [F.col("b_block") == F.col("block")]
    joined = rows.withColumn("inside", inside).join(blocks, functools.reduce(operator.and_, same))
    return joined.withColumn("place", F.col("before") + F.col("inside")).drop(*blocks.columns, "block", "inside")


def _pivot(units: DataFrame, seed: int) -> DataFrame:
    """key, source, size, bit: the settled documents of all levels of the tree."""
    most = units.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    level, settled = 0, []
    while most:
        chunks = math.ceil(most / CHUNK)
        folded = materialize(_fold(units, chunks, seed + 2 * level), f"mix-level{level}")
        settled.append(folded.select("source", F.inline("fold.out")))
        units = folded.select("source", F.inline(F.array("fold.left")))
        if chunks == 1:
            toss = (unit(F.lit(seed - 1), "key", "source", "size") < F.col("p")).cast("int")
            settled.append(units.select("source", "key", "size", toss.alias("bit")))
            break
        most, level = chunks, level + 1
    if not settled:
        return units.select("source", "key", "size", F.lit(0).alias("bit"))
    return functools.reduce(DataFrame.unionByName, settled)


def _fold(units: DataFrame, chunks: int, seed: int) -> DataFrame:
    """One row per source and chunk: who was settled and the one who is left."""
    doc = F.struct(
        (-F.col("words")).alias("turn"),  # large ones first: what is left at the end tends to be small
        F.xxhash64(F.lit(seed), "key", "size").alias("among"),
        F.col("key"),
        F.col("size"),
        F.col("words").cast("double").alias("words"),
        F.col("p"),
        unit(F.lit(seed + 1), "key", "source", "size").alias("draw"),
    )
    chunk = F.pmod(F.xxhash64(F.lit(seed), "source", "key", "size"), F.lit(chunks))
    grouped = units.groupBy("source", chunk.alias("chunk")).agg(F.array_sort(F.collect_list(doc)).alias("docs"))
    id_type = units.schema["key"].dataType.simpleString()
    left_type = f"struct<key:{id_type},size:bigint,words:double,p:double>"
    state = f"struct<left:{left_type},out:array<struct<key:{id_type},size:bigint,bit:int>>>"
    # up: words that can move to a (the one left over), down: words that a can give to b
    return grouped.select(
        "source",
        F.expr(f"""
            aggregate(
              docs,
              cast(struct(null, array()) as {state}),
              (acc, b) -> if(acc.left is null,
                cast(struct(struct(b.key, b.size, b.words, b.p), acc.out) as {state}),
                transform(array(struct(
                    acc.left as a,
                    least((1 - acc.left.p) * acc.left.words, b.p * b.words) as up,
                    least(acc.left.p * acc.left.words, (1 - b.p) * b.words) as down)),
                  m -> cast(case
                    when b.draw * (m.up + m.down) < m.down and m.up = (1 - m.a.p) * m.a.words then struct(
                      struct(b.key, b.size, b.words, greatest(0, b.p - m.up / b.words)),
                      concat(acc.out, array(named_struct('key', m.a.key, 'size', m.a.size, 'bit', 1))))
                    when b.draw * (m.up + m.down) < m.down then struct(
                      struct(m.a.key, m.a.size, m.a.words, least(1, m.a.p + m.up / m.a.words)),
                      concat(acc.out, array(named_struct('key', b.key, 'size', b.size, 'bit', 0))))
                    when m.down = m.a.p * m.a.words then struct(
                      struct(b.key, b.size, b.words, least(1, b.p + m.down / b.words)),
                      concat(acc.out, array(named_struct('key', m.a.key, 'size', m.a.size, 'bit', 0))))
                    else struct(
                      struct(m.a.key, m.a.size, m.a.words, greatest(0, m.a.p - m.down / m.a.words)),
                      concat(acc.out, array(named_struct('key', b.key, 'size', b.size, 'bit', 1))))
                  end as {state}))[0]))
        """).alias("fold"),
    )


def mix_rows(docs: DataFrame) -> DataFrame:
    """The digest of :func:`mix_sources` that the registered query returns."""
    out = mix_sources(docs)
    return out.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


def mixed_documents(
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    cap: int = 3,
    *,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    seed: int = 7,
) -> DataFrame:
    """The documents as often as the mix takes them, in the columns of ``docs``."""
    decided = _decide(_narrow(docs, key, source, text), weights, cap, seed)
    names = ("u_key", "u_source", "u_size", "n", "whole", "extra")
    new = fresh_names(docs, *names, "counted", "row", "no")
    plan = decided.select(*[F.col(n).alias(new[n]) for n in names])
    same = (
        F.col(key).eqNullSafe(F.col(new["u_key"]))
        & F.col(source).eqNullSafe(F.col(new["u_source"]))
        & (F.col(new["counted"]) == F.col(new["u_size"]))
    )
    counted = docs.withColumn(new["counted"], word_count(text))
    whole, extra, number = F.col(new["whole"]), F.col(new["extra"]), F.col(new["n"])
    some = (extra > 0) & (extra < number)
    joined = counted.join(plan.where(~some), same).select(*docs.columns, (whole + (extra > 0).cast("long")).alias(new["no"]))
    if not plan.where(some).isEmpty():
        alike = counted.join(plan.where(some), same).withColumn(new["row"], F.monotonically_increasing_id())
        alike = materialize(alike, "mix-alike")  # the numbers stay with the rows
        unit_of = [F.col(new[n]).alias(n) for n in names]
        places = _places(alike.select(*unit_of, F.col(new["row"]).alias("row")), ["u_key", "u_source", "u_size"])
        places = places.select(
            F.col("row").alias(new["u_key"]), (F.col("whole") + (F.col("place") < F.col("extra")).cast("long")).alias(new["no"])
        )
        alike = alike.select(*docs.columns, new["row"]).join(places, F.col(new["row"]) == F.col(new["u_key"]))
        joined = joined.unionByName(alike.select(*docs.columns, new["no"]))
    repeat = F.explode(F.sequence(F.lit(1), F.col(new["no"]).cast("int"))).alias(new["row"])
    return joined.where(F.col(new["no"]) > 0).select(*docs.columns, repeat).drop(new["row"])
