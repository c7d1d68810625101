"""Personal data: fixed patterns, and identifiers found by their contexts.

The base finds e-mail addresses, IP addresses, card numbers and phone numbers
by expressions. They are the seeds of a bootstrap: the words right before and
right behind a seed are lexical patterns. A pattern's score is the confidence
of the identifiers it points at over all places in the corpus where its word
stands, so ordinary words score near nothing. A token with digits or an "@"
that stands in the context of good patterns gets their joint confidence, and
raises the score of its other patterns in the next round. Tokens above a limit
are added under the kind of their best pattern.

Everything is DataFrame code. The expressions never backtrack over a run
(possessive loops), so time is linear in the text. Spans come from the lengths
of the matches and of the pieces between them. After one pass over the texts
only short rows are left; a second pass counts the words of the patterns.

Defined results: a null text is empty; spans count code points, the end is
exclusive; a found token leaves surrounding quotes, brackets and stops out and
never overlaps a base span; words of contexts are in lower case, with every
digit as 9, and have 60 characters at most; copies have the same spans; an
empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.llm.common import materialize
from calibra.session import small_side

KINDS = ("email", "ip", "card", "phone")
#: The expressions of the base, written without backtracking.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this character has no match.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
SPACE = r"\x20\x09-\x0D"
TOKEN = rf"(?<![^{SPACE}])[^{SPACE}@0-9]*+[@0-9][^{SPACE}]*+"  # a word with a digit or an "@"
DIGITS = 4  # that a token without "@" must have
CONTEXT = 60  # characters of a context word
BLOCK = 128  # matches whose lengths are added up at once

ROUNDS = 3
SUPPORT = 3  # different identifiers that a pattern must point at
PATTERN_SCORE, TOKEN_SCORE = 0.5, 0.7


def _matches(text: str, pattern: str, needs: str | None) -> Column:
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    none = F.expr("cast(array() as array<string>)")
    return F.when(F.contains(F.col(text), F.lit(needs)), found).otherwise(none) if needs else found


def _pieces(text: str, matches: str, pattern: str) -> Column:
    """What stands between the matches; only asked for when there are any."""
    return F.when(F.size(matches) > 0, F.split(F.col(text), pattern, -1))


def _starts(rows: DataFrame, name: str) -> DataFrame:
    """Adds ``name``_at: the first code point of every match, from block sums."""
    m, p = f"{name}_m", f"{name}_p"
    rows = rows.withColumn(f"{name}_n", F.expr(f"zip_with(slice({p}, 1, size({m})), {m}, (a, b) -> length(a) + length(b))"))
    n = f"{name}_n"
    rows = rows.withColumn(
        f"{name}_s",
        F.expr(f"""if(size({m}) > 0, transform(sequence(0, (size({n}) - 1) div {BLOCK}),
            b -> aggregate(slice({n}, cast(b * {BLOCK} + 1 as int), {BLOCK}), 0, (s, x) -> s + x)), null)"""),
    )
    rows = rows.withColumn(
        f"{name}_s",
        F.expr(f"transform({name}_s, (x, b) -> aggregate(slice({name}_s, 1, b), 0, (s, y) -> s + y))"),
    )
    # the arrays that a loop runs over stand as its argument: the optimizer may move their
    # expressions there, and inside the loop they would be made again for every match
    at = f"""flatten(transform({name}_s, (before, b) -> transform(slice({n}, b * {BLOCK} + 1, {BLOCK}),
        (x, j) -> before + aggregate(slice({n}, b * {BLOCK} + 1, j), 0, (s, y) -> s + y) + length({p}[b * {BLOCK} + j]))))"""
    return rows.withColumn(f"{name}_at", F.expr(at)).drop(n, f"{name}_s")


_LUHN = """aggregate(sequence(1, length({d})), 0, (s, i) -> s + int(substr({d}, -i, 1)) * (2 - i % 2)
    - if(i % 2 = 0 and int(substr({d}, -i, 1)) > 4, 9, 0)) % 10 = 0"""
_PART = "length(ltrim('0', x)) <= 3 and coalesce(try_cast(ltrim('0', x) as int), 0) <= 255"
_ONLY_DIGITS = "regexp_replace(z.v, '[^0-9]', '')"
_VALID = {
    "email": "true",
    "ip": f"forall(split(z.v, '[.]'), x -> {_PART})",
    "card": _LUHN.format(d=_ONLY_DIGITS),
    "phone": f"length({_ONLY_DIGITS}) between 10 and 15",
}


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, h1, h2, base, tokens of every row.

    ``base`` holds the base spans (at, kind, stop) with their values and
    contexts, ``tokens`` the words that may be identifiers with the same.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), raw.alias("t"))
    rows = rows.withColumns({f"{k}_m": _matches("t", PATTERNS[k], NEEDS.get(k)) for k in KINDS})
    rows = rows.withColumn("token_m", _matches("t", TOKEN, None))
    patterns = {**PATTERNS, "token": TOKEN}
    rows = rows.withColumns({f"{k}_p": _pieces("t", f"{k}_m", patterns[k]) for k in patterns})
    for name in patterns:
        rows = _starts(rows, name)
    spans = [
        F.expr(f"""coalesce(transform(
            filter(transform({k}_at, (a, i) -> struct(a, {k}_m[i] as v, {_context(k)})), z -> {_VALID[k]}),
            z -> struct(z.a as at, {no} as kind, z.a + length(z.v) as stop, z.v as value, z.left, z.right)), array())""")
        for no, k in enumerate(KINDS)
    ]
    bare = "regexp_extract(token_m[i], '^[\"\\'<(\\\\[{]*(.*?)[\"\\'>)\\\\]}.,;:!?]*$', 1)"
    tokens = f"""filter(
        transform(coalesce(token_at, array()), (a, i) -> struct(
            cast(a + locate({bare}, token_m[i]) - 1 as int) as at, {bare} as value, {_context("token")})),
        x -> instr(x.value, '@') > 0 or length(regexp_replace(x.value, '[^0-9]', '')) >= {DIGITS})"""
    return rows.select(
        "key",
        F.xxhash64("t").alias("h1"),
        F.xxhash64(F.lit(1), "t").alias("h2"),
        F.array_sort(F.concat(*spans)).alias("base"),
        F.expr(tokens).alias("tokens"),
    )


def _context(name: str) -> str:
    """The words before and behind match ``i``; next to another match, that match's word."""
    m, p, space = f"{name}_m", f"{name}_p", SPACE.replace("\\", "\\\\")  # doubled in SQL texts
    last, first = f"'([^{space}]+)[{space}]*$', 1", f"'[^{space}]+', 0"
    left = f"""if({p}[i] rlike '[^{space}]' or i = 0,
        regexp_extract(substr({p}[i], -{CONTEXT} - 2), {last}), regexp_extract({m}[i - 1], {last}))"""
    right = f"""if({p}[i + 1] rlike '[^{space}]' or i + 1 = size({m}),
        regexp_extract(substr({p}[i + 1], 1, {CONTEXT} + 2), {first}), regexp_extract({m}[i + 1], {first}))"""
    return f"{_word(left)} as left, {_word(right)} as right"


def _word(value: str) -> str:
    return f"translate(lower({value}), '0123456789', '9999999999')"


def discover(scanned: DataFrame, docs: DataFrame, *, text: str = "text") -> DataFrame:
    """h1, h2, at, kind, stop of the identifiers that contexts tell, once for all copies."""
    free = F.expr("""filter(tokens, x -> not exists(base, b -> b.at < x.at + length(x.value) and x.at < b.stop))""")
    found = F.expr("transform(base, b -> struct(b.at, b.value, b.left, b.right, b.kind as seed))")
    other = F.transform(free, lambda x: F.struct(x["at"], x["value"], x["left"], x["right"], F.lit(None).cast("int").alias("seed")))
    places = scanned.select("h1", "h2", F.explode(F.concat(found, other)).alias("x"))
    places = materialize(places.select("h1", "h2", "x.*"), "pii-places")
    sides = F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("left").alias("word")), F.struct(F.lit("r").alias("side"), F.col("right").alias("word"))))
    edges = places.select("value", "seed", sides.alias("p")).where(f"length(p.word) between 1 and {CONTEXT}").select("value", "seed", "p.*")
    edges = edges.groupBy("side", "word", "value", "seed").agg(F.count(F.lit(1)).alias("n"))
    edges = materialize(edges, "pii-edges")
    # a pattern belongs to the kinds of its seeds, and must have enough of them
    kinds = edges.where("seed is not null").groupBy("side", "word", F.col("seed").alias("kind"))
    kinds = materialize(kinds.agg(F.count_distinct("value").alias("support")).where(f"support >= {SUPPORT}"), "pii-kinds")
    count = kinds.count()
    words = kinds.select("word").distinct()
    words = words.withColumnRenamed("word", "known")
    spoken = docs.select(F.explode(F.split(F.coalesce(F.col(text), F.lit("")), rf"[{SPACE}]+")).alias("w"))
    spoken = spoken.where(F.length("w") <= CONTEXT).select(F.expr(_word("w")).alias("word"))
    spoken = spoken.join(small_side(words, count), F.col("word") == F.col("known"), "left_semi")
    totals = spoken.groupBy("word").agg(F.count(F.lit(1)).alias("places"))
    patterns = materialize(kinds.join(totals, "word").select("side", "word", "kind", "places"), "pii-patterns")
    graph = edges.join(small_side(patterns, count), ["side", "word"])
    graph = graph.where("seed is null or seed = kind")
    graph = materialize(graph.select("side", "word", "kind", "places", "value", "n", F.col("seed").isNotNull().alias("sure")), "pii-graph")

    trust = None
    for _ in range(ROUNDS):
        believed = graph.withColumn("c", F.col("sure").cast("double"))
        if trust is not None:
            believed = graph.join(trust, ["value", "kind"], "left").withColumn(
                "c", F.when(F.col("sure"), 1.0).otherwise(F.coalesce("trust", F.lit(0.0)))
            )
        scored = believed.groupBy("side", "word", "kind").agg(
            (F.sum(F.col("c") * F.col("n")) / F.max("places")).alias("score"),
            F.count_distinct(F.when(F.col("c") >= TOKEN_SCORE, F.col("value"))).alias("support"),
        )
        scored = scored.where((F.col("score") >= PATTERN_SCORE) & (F.col("support") >= SUPPORT)).drop("support")
        reached = graph.where("not sure").join(scored, ["side", "word", "kind"])
        miss = F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9))))
        trust = materialize(reached.groupBy("value", "kind").agg((1 - F.exp(miss)).alias("trust")), "pii-trust")
    best = trust.where(F.col("trust") >= TOKEN_SCORE).groupBy("value")
    best = materialize(best.agg(F.max_by("kind", F.struct("trust", -F.col("kind"))).alias("kind")), "pii-found")
    new = places.where("seed is null").join(small_side(best, best.count()), "value")
    stop = (F.col("at") + F.length("value")).alias("stop")
    return materialize(new.select("h1", "h2", "at", "kind", stop).distinct(), "pii-new")


def _text(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["at"].cast("string"), s["stop"].cast("string"))), ","
    )


def find_personal_data(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, base, spans: arrays of (at, kind, stop) for every row; ``spans`` has the found ones too."""
    scanned = materialize(scan(docs, key=key, text=text), "pii-scan")
    new = discover(scanned, docs, text=text)
    added = new.groupBy(F.col("h1").alias("n1"), F.col("h2").alias("n2")).agg(
        F.collect_list(F.struct("at", "kind", "stop")).alias("more")
    )
    added = materialize(added, "pii-added")
    same = (F.col("h1") == F.col("n1")) & (F.col("h2") == F.col("n2"))
    scanned = scanned.withColumn("base", F.expr("transform(base, b -> struct(b.at, b.kind, b.stop))"))
    joined = scanned.join(small_side(added, added.count()), same, "left")
    every = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    return joined.select("key", "base", every.alias("spans"))


def pii_rows(docs: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and all spans of every document."""
    found = find_personal_data(docs)
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {no})) as bigint)").alias(f"n_{k}") for no, k in enumerate(KINDS)]
    return found.select(
        F.col("key").alias("doc_id"),
        *counts,
        F.sha2(_text(F.col("base")), 256).alias("base_sha256"),
        _text(F.col("spans")).alias("spans"),
    )
