"""Removal of repeated runs of lines.

Every run of ``WINDOW`` lines is a chunk, at whatever line it begins, so the
same lines give the same chunks wherever they stand. Boundaries chosen by a
hash over the lines, the first form of this operator, kept about a third of the
lines of short repeated runs and were given up. A chunk that occurs more than
once in the whole table stays at its first place; elsewhere its lines go, after
its bytes were compared with the first occurrence. A line of a first place is
never removed, so every repeated chunk still stands whole somewhere. Chunks
travel as digests; bytes are fetched for first occurrences of repeated chunks
only, and a text is shuffled once.

The first place is the least document id (null last), then the hashes of the
text, then the position.

Defined results: a line ends at a line feed; a run of one line, or a chunk
without any word, is never removed; of one line many times in a row the first
``WINDOW`` stay; where a removed run and the first place of another run share
a line, that line stays; a null text stays null; rows alike in id and text are
treated alike, so both keep a first occurrence; a text whose lines all go
becomes empty; an empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.llm.common import fresh_names, materialize
from calibra.session import small_side

WINDOW = 2  # lines of a chunk, and of the shortest run that is removed


def _chunks(raw: bytes | None) -> Iterator[tuple[int, int, bytes]]:
    """first line, lines, bytes of the chunks that may be removed."""
    if not raw:
        return
    lines = raw.split(b"\n")
    for a in range(len(lines) - WINDOW + 1):
        chunk = b"\n".join(lines[a : a + WINDOW])
        if not chunk.isspace() and chunk:
            yield a, WINDOW, chunk


def _digest(chunk: bytes) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_digest(chunk)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    raw = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias("key"),
        F.xxhash64(raw).alias("t1"),
        F.xxhash64(F.lit(1), raw).alias("t2"),
        F.col(text).cast("binary").alias("raw"),
    )


def _occurrences(rows: DataFrame) -> DataFrame:
    """key, t1, t2, line, lines, d1, d2 of every chunk."""
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, line, lines, d1, d2 = [], [], [], [], []
            for i, raw in enumerate(batch.column(3).to_pylist()):
                for a, n, chunk in _chunks(raw):
                    one, two = _digest(chunk)
                    of.append(i)
                    line.append(a)
                    lines.append(n)
                    d1.append(one)
                    d2.append(two)
            at = pa.array(of, pa.int32())
            numbers = [pa.array(x, pa.int64()) for x in (line, lines, d1, d2)]
            yield pa.RecordBatch.from_arrays(
                [*[c.take(at) for c in batch.columns[:3]], *numbers], names=["key", "t1", "t2", "line", "lines", "d1", "d2"]
            )

    return rows.mapInArrow(run, f"key {kind}, t1 bigint, t2 bigint, line bigint, lines bigint, d1 bigint, d2 bigint")


def _first_bytes(rows: DataFrame, first: DataFrame) -> DataFrame:
    """d1, d2, chunk: the bytes of the first occurrences."""
    wanted = first.groupBy("f_key", "f_t1", "f_t2").agg(F.collect_list(F.struct("f_line", "f_lines", "d1", "d2")).alias("of"))
    wanted = small_side(wanted, first.count())  # a few numbers per repeated chunk
    same = (
        F.col("key").eqNullSafe(F.col("f_key")) & (F.col("t1") == F.col("f_t1")) & (F.col("t2") == F.col("f_t2"))
    )
    found = rows.join(wanted, same).select("raw", "of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, of in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                lines = raw.split(b"\n")
                for x in of:
                    a = x["f_line"]
                    out.append({"d1": x["d1"], "d2": x["d2"], "chunk": b"\n".join(lines[a : a + x["f_lines"]])})
            shape = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("chunk", pa.binary())])
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    return found.mapInArrow(run, "d1 bigint, d2 bigint, chunk binary").dropDuplicates(["d1", "d2"])  # rows alike


def dedup_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the cleaned text, and n_lines, n_removed (lines), n_chunks (removed runs).

    The three new columns are named otherwise where ``docs`` has such names.
    """
    rows = _keyed(docs, key, text)
    seen = materialize(_occurrences(rows), "line-chunks")
    place = F.struct(F.col("key").isNull().alias("no_key"), "key", "t1", "t2", "line", "lines")
    repeated = seen.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1")
    first = repeated.select("d1", "d2", *[F.col(f"first.{c}").alias(f"f_{c}") for c in ("key", "t1", "t2", "line", "lines")])
    first = materialize(first, "line-first")
    known = materialize(first.join(_first_bytes(rows, first), ["d1", "d2"]), "line-bytes")
    is_first = (
        F.col("key").eqNullSafe(F.col("f_key"))
        & (F.col("t1") == F.col("f_t1"))
        & (F.col("t2") == F.col("f_t2"))
        & (F.col("line") == F.col("f_line"))
    )
    gone = seen.join(known, ["d1", "d2"]).where(~is_first)
    kept = first.select(*[F.col(f"f_{c}").alias(c) for c in ("key", "t1", "t2", "line", "lines")], F.lit(None).cast("binary").alias("chunk"))
    plan = gone.select(*kept.columns).unionByName(kept).groupBy("key", "t1", "t2")
    plan = plan.agg(F.collect_set(F.struct("line", "lines", "chunk")).alias("of")).where(F.exists("of", lambda x: x["chunk"].isNotNull()))
    new = fresh_names(docs, "key", "t1", "t2", "of")
    plan = materialize(plan.select(*[F.col(c).alias(new[c]) for c in ("key", "t1", "t2", "of")]), "line-plan")
    raw = F.coalesce(F.col(text), F.lit(""))
    same = (
        F.col(key).eqNullSafe(F.col(new["key"]))
        & (F.xxhash64(raw) == F.col(new["t1"]))
        & (F.xxhash64(F.lit(1), raw) == F.col(new["t2"]))
    )
    joined = docs.join(plan, same, "left").select(*docs.columns, new["of"])
    return _remove(joined, text, docs)


def _remove(joined: DataFrame, text: str, docs: DataFrame) -> DataFrame:
    at, last = docs.columns.index(text), len(docs.columns)
    have = {c.lower() for c in docs.columns}
    names = [n if n not in have else fresh_names(docs, n)[n] for n in ("n_lines", "n_removed", "n_chunks")]
    shape = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{n}` bigint" for n in names]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            kept, counts = [], []
            for raw, of in zip(texts, batch.column(last).to_pylist(), strict=True):
                lines = (raw or b"").split(b"\n")
                gone: set[int] = set()
                first: set[int] = set()
                for x in of or []:
                    a, b = x["line"], x["line"] + x["lines"]
                    if x["chunk"] is None:
                        first.update(range(a, b))
                    elif b"\n".join(lines[a:b]) == x["chunk"]:
                        gone.update(range(a, b))
                gone -= first
                kept.append(None if raw is None else b"\n".join(x for i, x in enumerate(lines) if i not in gone))
                counts.append((len(lines) if raw else 0, len(gone), sum(i - 1 not in gone for i in gone)))
            columns = list(batch.columns[:last])
            columns[at] = pa.array(kept, pa.binary()).cast(pa.string())
            numbers = [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, *numbers], names=[*docs_names, *names])

    docs_names = list(docs.columns)
    return joined.mapInArrow(run, shape)


def line_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_lines, n_removed, n_chunks of every document."""
    return dedup_lines(docs.select("doc_id", "text"))
