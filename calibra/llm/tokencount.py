"""Token counts that follow edits.

A text is split into pre-tokens; tokens never cross them, so counts add up. A
segment tree per document holds, over leaves of ``LEAF`` pre-tokens, the
characters and the tokens below every node. An edit finds its leaves by
walking down the character sums, splits and counts again from the first leaf
that the edit can change, stops at the first leaf boundary behind the edit at
which the new pre-tokens meet the old ones, and updates the sums on the paths
to the root. The rest of the text is not read again.

Splitting looks at no character before a pre-token and at most one behind its
end and the next, so a pre-token that ends two characters before an edit
stays; and from a common boundary on the same text splits alike.

Defined results: a null text is empty and has 0 tokens; an edit outside the
text is moved to its end; edits apply one after another, each to the text that
the one before left; null edits, and null parts of an edit, change nothing; an
empty input gives no rows.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.llm.common import fresh_names

LEAF = 32  # pre-tokens of a new leaf
CACHE_PIECES = 600_000


class _Known(dict):
    """Tokens of a pre-token, counted when it is first asked for."""

    def __init__(self, library: object):
        super().__init__()
        self.library = library

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE_PIECES:
            self.clear()
        n = self[piece] = len(self.library.encode_ordinary(piece))
        return n


class PieceCounter:
    """Pre-tokens of a text and the number of tokens of each, which is kept."""

    #: Letters and digits below U+0250, for the standard library's faster expressions.
    LETTERS, DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{self.LETTERS}{self.DIGITS}]")
        plain = plain.replace(r"\p{L}", f"[{self.LETTERS}]").replace(r"\p{N}", f"[{self.DIGITS}]")
        self.plain = re.compile(plain) if r"\p" not in plain else None
        self.known = _Known(library)

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens; plain texts by the faster expression, which splits them alike."""
        plain = self.plain is not None and not any(c in text for c in "\x1c\x1d\x1e\x1f")
        if plain and not text.isascii():
            plain = np.frombuffer(text.encode(), np.uint8).max() <= 0xC8  # up to U+023F
        return self.plain.findall(text) if plain else self.pattern.findall(text)

    def counts(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))


@dataclass
class CountTree:
    """Levels from the leaves to the root; a row is (characters, tokens)."""

    levels: list[np.ndarray]

    @classmethod
    def of_text(cls, text: str, counter: PieceCounter) -> CountTree:
        pieces = counter.pieces(text)
        return cls.of_leaves(_leaves(pieces, counter, max(1, -(-len(pieces) // LEAF))))

    @classmethod
    def of_leaves(cls, leaves: np.ndarray) -> CountTree:
        levels = [leaves]
        while len(levels[-1]) > 1:
            level = levels[-1]
            if len(level) % 2:
                level = np.concatenate([level, np.zeros((1, 2), level.dtype)])
            levels.append(level.reshape(-1, 2, 2).sum(axis=1))
        return cls(levels)

    @property
    def tokens(self) -> int:
        return int(self.levels[-1][0, 1])

    @property
    def chars(self) -> int:
        return int(self.levels[-1][0, 0])

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character (the last one for the end), and its first character."""
        node, before = 0, 0
        for level in reversed(self.levels[:-1]):
            node *= 2
            if node + 1 < len(level) and place - before >= level[node, 0] and level[node + 1 :].any():
                before += int(level[node, 0])
                node += 1
        return node, before

    def edit(self, text: str, start: int, stop: int, new: str, counter: PieceCounter) -> tuple[str, int]:
        """The new text, and the characters that were split and counted again."""
        start = min(max(0, start), len(text))
        stop = min(max(start, stop), len(text))
        changed = text[:start] + new + text[stop:]
        shift = len(changed) - len(text)
        leaves = self.levels[0]
        first, at = self.find(max(0, start - 2))
        begin = at
        last, edge = self.find(stop)
        edge += int(leaves[last, 0])  # the end of leaf ``last`` in the old text
        last += 1
        pieces = []
        while at < len(changed):
            found = counter.pattern.match(changed, at)
            pieces.append(found.group())
            at = found.end()
            while last < len(leaves) and edge + shift < at:
                edge += int(leaves[last, 0])
                last += 1
            if at >= start + len(new) and at == edge + shift:
                break
        else:
            last = len(leaves)
        fits = last - first
        if len(pieces) > 4 * LEAF * fits:  # the leaves would grow too large
            grown = _leaves(pieces, counter, -(-len(pieces) // LEAF))
            self.levels = self.of_leaves(np.concatenate([leaves[:first], grown, leaves[last:]])).levels
        else:
            leaves[first:last] = _leaves(pieces, counter, fits)
            self._sum_up(first, last)
        return changed, at - begin

    def _sum_up(self, first: int, last: int) -> None:
        for below, level in zip(self.levels[:-1], self.levels[1:], strict=True):
            first, last = first // 2, (last - 1) // 2 + 1
            for node in range(first, last):
                level[node] = below[2 * node : 2 * node + 2].sum(axis=0)

    def to_bytes(self) -> bytes:
        return struct.pack("<I", len(self.levels[0])) + b"".join(x.astype("<u4").tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> CountTree:
        (n,) = struct.unpack_from("<I", data)
        nodes, levels, at = np.frombuffer(data, "<u4", offset=4).astype(np.int64).reshape(-1, 2), [], 0
        while True:
            levels.append(nodes[at : at + n])
            if n == 1:
                return cls(levels)
            at, n = at + n, -(-n // 2)


def _leaves(pieces: list[str], counter: PieceCounter, n: int) -> np.ndarray:
    """``n`` leaves over the pieces, near equal in number."""
    out = np.zeros((n, 2), np.int64)
    leaf = np.arange(len(pieces)) * n // max(1, len(pieces))
    np.add.at(out, leaf, np.stack([np.fromiter(map(len, pieces), np.int64, len(pieces)), counter.counts(pieces)], axis=1))
    return out


def with_trees(docs: DataFrame, ranks: str, pattern: str, *, text: str = "text", name: str = "tree") -> DataFrame:
    """``docs`` with the tree of every text in a binary column. ``ranks`` is read on the workers."""
    at = docs.columns.index(text)
    names = [*docs.columns, name]
    shape = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], f"`{name}` binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(ranks, pattern)
        for batch in batches:
            trees = [CountTree.of_text(t or "", counter).to_bytes() for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(trees, pa.binary())], names=names)

    return docs.mapInArrow(run, shape)


EDIT = "struct<start:bigint,stop:bigint,new:string>"


def recount(
    docs: DataFrame, ranks: str, pattern: str, *, edits: str, text: str = "text", tree: str = "tree"
) -> DataFrame:
    """``docs`` after its ``edits``: the new text and tree in their places.

    New columns: tokens_before, tokens_after, chars_read (that were split
    again), named otherwise where ``docs`` has such names.
    """
    have = {c.lower() for c in docs.columns}
    more = [n if n not in have else fresh_names(docs, n)[n] for n in ("tokens_before", "tokens_after", "chars_read")]
    names = [*docs.columns, *more]
    places = [docs.columns.index(c) for c in (text, tree, edits)]
    shape = ", ".join(
        [*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], *[f"`{n}` bigint" for n in more]]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(ranks, pattern)
        for batch in batches:
            texts, trees, numbers = [], [], []
            for now, data, changes in zip(*[batch.column(i).to_pylist() for i in places], strict=True):
                held, read = CountTree.from_bytes(data), 0
                before = held.tokens
                for e in _valid(changes):
                    now, n = held.edit(now or "", e["start"], e["stop"], e["new"], counter)
                    read += n
                texts.append(now)
                trees.append(held.to_bytes())
                numbers.append((before, held.tokens, read))
            columns = list(batch.columns)
            columns[places[0]] = pa.array(texts, pa.string())
            columns[places[1]] = pa.array(trees, pa.binary())
            columns += [pa.array([x[k] for x in numbers], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, shape)


def _valid(edits: Sequence[dict | None] | None) -> list[dict]:
    return [e for e in edits or [] if e and None not in (e["start"], e["stop"], e["new"])]


def revision(key: str = "doc_id", text: str = "text") -> Column:
    """Three edits that follow from a document: a cut, a replacement, an insertion.

    Their places and words are hashes of the id, so every document gets others.
    """
    size = F.coalesce(F.length(text), F.lit(0)).cast("long")

    def draw(k: int, n: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(k), F.col(key)), F.greatest(n, F.lit(1)))

    def word(k: int) -> Column:
        return F.substring(F.hex(F.xxhash64(F.lit(k), F.col(key))), 1, 8)

    def one(start: Column, length: Column, new: Column) -> Column:
        return F.struct(start.alias("start"), (start + length).alias("stop"), new.alias("new"))

    return F.array(
        one(draw(1, size), draw(2, F.lit(40)), F.lit("")),
        one(draw(3, size), draw(4, F.lit(12)), F.concat(word(5), F.lit(" "))),
        one(draw(6, size), F.lit(0).cast("long"), F.concat(F.lit(" "), word(7))),
    ).cast(f"array<{EDIT}>")


def count_rows(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, tokens_before, tokens_after, chars_read of every document and its revision."""
    trees = with_trees(docs.select("doc_id", "text"), ranks, pattern)
    edited = trees.withColumn("edits", revision())
    return recount(edited, ranks, pattern, edits="edits").select("doc_id", "tokens_before", "tokens_after", "chars_read")
