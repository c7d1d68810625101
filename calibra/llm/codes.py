"""Token ids in files of directly addressable codes.

A file holds the ids of consecutive documents. Its ids are numbered by falling
frequency, and a table in the file tells the id of each number, so frequent ids
have short codes. A number is cut into chunks of eight bits. Level 0 has the
lowest chunk of every number, and a bitmap tells which go on; level 1 has the
next chunk of those that do, and so on; on the last level none goes on, so it
has no bitmap. A rank directory counts the set bits before every block of 512,
so the place of a number on the next level is one lookup and a few bit counts:
any id is read without decoding others.

The documents are range-partitioned and sorted by id, so files in the order of
their names hold the documents in ascending order. Tasks write a hidden file
and rename it; a repeated task writes the same bytes again.

Words are encoded once as long as a worker remembers them. Its memory is bounded
in bytes: ``CACHE_BYTES`` of words used lately, one slice of ``SLICE_BYTES`` of
text with its words, and the ids of one file as two bytes each (four, where they
need more), which become levels slice by slice. Reading takes the header and then runs of at most ``READ_IDS`` ids from the file. The tokenizer drops white space and treats
the pieces of a text apart, so the ids of a text are those of its words in
order, and a plain word is its letters, then its signs. Both are checked
against the library in the tests; whatever is not plain goes to the library.

Defined results: a null text is an empty one; null ids come first; equal ids
follow each other in the order of a hash of their text; an empty input writes
no file and gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from calibra.llm.common import materialize, scratch_path
from calibra.session import small_side

MAGIC = b"DAC2"
CHUNK_BITS = 8
BLOCK_BITS = 512
FILE_BYTES, FILE_MOST, FILES = 16 << 20, 64 << 20, 10_000  # text behind one file: more, up to a limit, above so many files
SLICE_BYTES = 1 << 20  # text that is encoded at once
CACHE_BYTES = 24 << 20  # words and their ids that a worker remembers, with what Python needs for them
ENTRY_BYTES = 170  # of a kept word, beside its letters and ids
READ_IDS = 1 << 20  # ids that are coded or decoded at once
TABLE_IDS = 1 << 22  # ids below are looked up by place

_PLAIN = re.compile("([a-zß-öø-ÿœ]+)([.,!?;:#$%&*]*)")


def _byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable bytes of Latin-1 stand for themselves, the others for the
    characters from 256 on, in order.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Kept:
    """A dictionary that forgets what was not asked for lately, bounded in bytes.

    ``now`` has what was used since the last turn, ``before`` what was used in
    the turn before that; rare words fall out after two turns.
    """

    def __init__(self, most: int):
        self.most = most // 2
        self.now: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.size = 0

    def missing(self, words: set[bytes]) -> list[bytes]:
        """The words that are not known; those of the last turn come over to this one."""
        unknown = []
        for word in words.difference(self.now):
            found = self.before.get(word)
            if found is None:
                unknown.append(word)
            else:
                self.add(word, found)
        return unknown

    def add(self, word: bytes, value: bytes) -> None:
        self.now[word] = value
        self.size += len(word) + len(value) + ENTRY_BYTES

    def turn(self) -> None:
        """Forget, if it is time; not while a slice is being encoded."""
        if self.size > self.most:
            self.before, self.now, self.size = self.now, {}, 0


class WordEncoder:
    """Ids of whole texts from the ids of their words, which are kept for a while."""

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model  # for plain pieces, which need no normalizer and no splitting
        self.letters = dict(enumerate(_byte_letters()))
        self.end = np.array([end], "<u4").tobytes()
        self.kept = Kept(CACHE_BYTES)  # ids as packed numbers, which the garbage collector skips

    @staticmethod
    def words(raw: bytes) -> list[bytes]:
        """Runs without ASCII white space, in lower case where that is surely the tokenizer's own."""
        if b"<|" in raw:
            return raw.split()
        if raw.isascii():
            return raw.lower().split()
        if np.frombuffer(raw, np.uint8).max() <= 0xC9:  # up to U+027F
            return raw.decode().lower().encode().split()
        return raw.split()

    def _piece(self, piece: str) -> bytes:
        """The ids of a plain piece, by the model alone."""
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _learn(self, missing: list[bytes]) -> None:
        other: list[bytes] = []
        signs: dict[str, bytes] = {"": b""}
        for word in missing:
            cut = _PLAIN.fullmatch(word.decode())
            if cut is None:
                other.append(word)
                continue
            one, two = cut.groups()
            if two not in signs:
                signs[two] = self._piece(two)
            self.kept.add(word, self._piece(one) + signs[two])
        done = self.library.encode_batch_fast([w.decode() for w in other], add_special_tokens=False)
        for word, found in zip(other, done, strict=True):
            self.kept.add(word, array("I", found.ids).tobytes())

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, every text closed by the end id, and the number of ids of each text."""
        words = [self.words(raw or b"") for raw in texts]
        missing = self.kept.missing(set().union(*words))
        if missing:
            self._learn(missing)
        known = self.kept.now
        parts = [b"".join([*map(known.__getitem__, some), self.end]) for some in words]
        counts = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        self.kept.turn()
        return np.frombuffer(b"".join(parts), "<u4"), counts


@functools.lru_cache(maxsize=1)
def encoder_of(path: str, end: int) -> WordEncoder:
    """One encoder for all tasks of a worker."""
    return WordEncoder(path, end)


class Level:
    """One level that grows: a chunk of every id, the bits of those that go on, bits before each block."""

    def __init__(self) -> None:
        self.chunks, self.bits = bytearray(), bytearray()
        self.rank = array("Q", [0])
        self.open = np.zeros(0, bool)  # bits of the unfinished block

    def add(self, values: np.ndarray) -> np.ndarray:
        """Takes values; returns what is left of those that go on."""
        more = values >> CHUNK_BITS > 0
        self.chunks += values.astype(np.uint8).tobytes()
        held = np.concatenate([self.open, more])
        whole = len(held) // BLOCK_BITS * BLOCK_BITS
        self._close(held[:whole])
        self.open = held[whole:]
        return values[more] >> CHUNK_BITS

    def _close(self, bits: np.ndarray) -> None:
        self.bits += np.packbits(bits, bitorder="little").tobytes()
        ones = bits.reshape(-1, BLOCK_BITS).sum(axis=1, dtype=np.int64)
        self.rank.extend((self.rank[-1] + np.cumsum(ones)).tolist())

    def parts(self, last: bool) -> list[bytes | bytearray | array]:
        """What a file holds of the level, after its last value."""
        size = struct.pack("<Q", len(self.chunks))
        if last:
            return [size, self.chunks]
        if len(self.open):
            self._close(np.pad(self.open, (0, -len(self.open) % BLOCK_BITS)))
            self.open = np.zeros(0, bool)
        return [size, self.chunks, self.bits, self.rank]


class Numbers:
    """The ids of a file by falling frequency, smaller ids first among equals."""

    def __init__(self, slices: list[np.ndarray]):
        most = max((int(s.max()) for s in slices if len(s)), default=-1) + 1
        if most <= TABLE_IDS:
            counts = np.zeros(most, np.int64)
            for s in slices:
                counts += np.bincount(s, minlength=most)
            own = np.flatnonzero(counts)
            counts = counts[own]
        else:
            found: dict[int, int] = {}
            for s in slices:
                for value, n in zip(*(x.tolist() for x in np.unique(s, return_counts=True)), strict=True):
                    found[value] = found.get(value, 0) + n
            own = np.array(sorted(found), np.int64)
            counts = np.array([found[v] for v in own.tolist()], np.int64)
        order = np.argsort(-counts, kind="stable")
        self.ids = own[order].astype("<u4")  # of each number
        number = np.empty(len(own), np.uint32)
        number[order] = np.arange(len(own), dtype=np.uint32)
        if most <= TABLE_IDS:
            self.table = np.zeros(most, np.uint32)
            self.table[own] = number
            self.of = self.table.__getitem__
        else:
            self.of = lambda s: number[np.searchsorted(own, s)]


class TokenWriter:
    """Collects documents and writes one file.

    Header: magic, documents, ids, levels, different ids. Then the keys, a byte
    per key that tells null, the first id of every document, the different ids
    by falling frequency, and for each level its length and chunks, and, but
    for the last level, bitmap and rank directory. All numbers are
    little-endian.
    """

    def __init__(self) -> None:
        self.keys, self.nulls = array("q"), bytearray()
        self.starts = array("Q", [0])
        self.ids: list[np.ndarray] = []

    def add(self, keys: list[int | None], counts: np.ndarray, ids: np.ndarray) -> None:
        self.keys.extend(0 if k is None else k for k in keys)
        self.nulls += bytes(k is None for k in keys)
        self.starts.extend((self.starts[-1] + np.cumsum(counts)).tolist())
        if len(ids):
            self.ids.append(ids.astype(np.uint16 if ids.max() < 1 << 16 else np.uint32))

    def parts(self) -> Iterator[bytes | bytearray | array]:
        """What the file holds; the ids that were collected are given up on the way."""
        numbers, levels = Numbers(self.ids), [Level()]
        self.ids.reverse()
        while self.ids:
            some = self.ids.pop()
            for lo in range(0, len(some), READ_IDS):
                rest, depth = numbers.of(some[lo : lo + READ_IDS]), 0
                while len(rest):
                    if depth == len(levels):
                        levels.append(Level())
                    rest, depth = levels[depth].add(rest), depth + 1
        yield MAGIC + struct.pack("<QQII", len(self.keys), self.starts[-1], len(levels), len(numbers.ids))
        yield from (self.keys, self.nulls, self.starts, numbers.ids.tobytes())
        for i, level in enumerate(levels):
            yield from level.parts(i + 1 == len(levels))


def pack(keys: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of one file of few documents."""
    writer = TokenWriter()
    writer.add(keys, counts, ids)
    return b"".join(bytes(p) for p in writer.parts())


class TokenFile:
    """One file: any id, any run of ids, any document.

    Only the header, the keys, the starts and the different ids are kept; an id costs one short
    read per level, from the bytes given or from a file open for random access.
    """

    def __init__(self, source: bytes | pa.NativeFile):
        self.source = pa.BufferReader(source) if isinstance(source, (bytes, bytearray, memoryview, pa.Buffer)) else source
        if self._at(0, 4) != MAGIC:
            raise ValueError("not a token file")
        n, self.size, depth, different = struct.unpack("<QQII", self._at(4, 24))
        at = 4 + 24
        numbers = np.frombuffer(self._at(at, 8 * n), "<i8")
        nulls = np.frombuffer(self._at(at + 8 * n, n), np.uint8)
        self.keys = [None if z else int(k) for k, z in zip(numbers, nulls, strict=True)]
        self.starts = np.frombuffer(self._at(at + 9 * n, 8 * (n + 1)), "<u8").astype(np.int64)
        at += 9 * n + 8 * (n + 1)
        self.ids = np.frombuffer(self._at(at, 4 * different), "<u4")  # of each number
        at += 4 * different
        self.levels = []  # places of chunks, bitmap and rank directory
        for _ in range(depth):
            (length,) = struct.unpack("<Q", self._at(at, 8))
            blocks = -(-length // BLOCK_BITS)
            bits = at + 8 + length
            rank = bits + blocks * BLOCK_BITS // 8
            self.levels.append((at + 8, bits, rank))
            at = rank + 8 * (blocks + 1)

    def _at(self, place: int, n: int) -> bytes:
        return self.source.read_at(n, place)

    def token(self, i: int) -> int:
        """The id at place ``i``, from one chunk per level."""
        value = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= self._at(chunks + i, 1)[0] << (CHUNK_BITS * level)
            if level + 1 == len(self.levels) or not self._at(bits + (i >> 3), 1)[0] >> (i & 7) & 1:
                break
            i = self._rank(level, i)
        return int(self.ids[value])

    def _rank(self, level: int, i: int) -> int:
        """The set bits of a level before place ``i``."""
        _, bits, rank = self.levels[level]
        block = i // BLOCK_BITS
        before = int.from_bytes(self._at(rank + 8 * block, 8), "little")
        first = block * BLOCK_BITS // 8
        inside = int.from_bytes(self._at(bits + first, (i + 7) // 8 - first), "little")
        return before + (inside & ((1 << (i - block * BLOCK_BITS)) - 1)).bit_count()

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to ``stop``; each level is read in one run."""
        out = np.zeros(max(0, stop - start), np.uint32)
        where = np.arange(len(out), dtype=np.int32 if len(out) < 1 << 31 else np.int64)
        lo, hi = start, max(start, stop)
        for level, (chunks, bits, _) in enumerate(self.levels):
            if hi <= lo:
                break
            out[where] |= np.frombuffer(self._at(chunks + lo, hi - lo), np.uint8).astype(np.uint32) << (CHUNK_BITS * level)
            if level + 1 == len(self.levels):
                break
            held = np.frombuffer(self._at(bits + (lo >> 3), ((hi + 7) >> 3) - (lo >> 3)), np.uint8)
            more = np.unpackbits(held, bitorder="little")[lo & 7 :][: hi - lo].view(bool)
            where = where[more]
            lo = self._rank(level, lo)
            hi = lo + len(where)
        return self.ids[out] if len(out) else out

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.starts[k]), int(self.starts[k + 1]))

    def runs(self) -> Iterator[tuple[int, int]]:
        """Neighbouring documents with at most READ_IDS ids together, or one longer document."""
        lo, n = 0, len(self.keys)
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(self.starts, self.starts[lo] + READ_IDS, "right")) - 1)
            yield lo, min(hi, n)
            lo = hi

    def checksum(self, k: int) -> int:
        """The crc32 of a document's ids as little-endian numbers, READ_IDS at a time."""
        value, last = 0, int(self.starts[k + 1])
        for lo in range(int(self.starts[k]), last, READ_IDS):
            value = zlib.crc32(self.tokens(lo, min(lo + READ_IDS, last)).astype("<u4"), value)
        return value


def _put(store: fs.FileSystem, hidden: str, name: str) -> None:
    """Rename a complete file; where an earlier attempt has put the same bytes there, those stay."""
    try:
        store.move(hidden, name)
    except OSError:
        if store.get_file_info(name).type != fs.FileType.File:
            raise
        store.delete_file(hidden)


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    folder: str | None = None,
    *,
    key: str = "doc_id",
    text: str = "text",
    end: int = 1,
    file_bytes: int | None = None,
) -> tuple[str, DataFrame]:
    """The folder of the files, and one row per file: name, n_docs, n_tokens.

    ``tokenizer`` is the path of the tokenizer's file; it is read on the workers.
    """
    folder = folder or scratch_path(docs.sparkSession, "token-files")
    raw = F.col(text).cast("binary")
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    rows = docs.select(F.col(key).cast("long").alias("key"), raw.alias("raw"))
    among = F.xxhash64("raw")  # parts equal keys, so that no key has to fit in one file
    file_bytes = file_bytes or min(FILE_MOST, max(FILE_BYTES, total // FILES))
    parts = max(1, -(-total // file_bytes))
    rows = rows.withColumn("among", among).repartitionByRange(parts, "key", "among")
    rows = rows.sortWithinPartitions("key", "among").select("key", "raw")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer = encoder_of(tokenizer, end), TokenWriter()
        for batch in batches:
            lo, held = 0, 0
            for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
                held += n
                if held >= SLICE_BYTES or i + 1 == batch.num_rows:
                    some = batch.slice(lo, i + 1 - lo)
                    ids, counts = encoder.encode(some.column(1).to_pylist())
                    writer.add(some.column(0).to_pylist(), counts, ids)
                    lo, held = i + 1, 0
        if not len(writer.keys):
            return
        name = f"part-{TaskContext.get().partitionId():06d}.dac"
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        hidden = f"{root}/_{name}-{uuid.uuid4().hex}"
        with store.open_output_stream(hidden) as out:
            for part in writer.parts():
                out.write(memoryview(part).cast("B") if len(part) else b"")
        _put(store, hidden, f"{root}/{name}")
        yield pa.RecordBatch.from_pylist(
            [{"name": name, "n_docs": len(writer.keys), "n_tokens": writer.starts[-1]}],
            schema=pa.schema([("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
        )

    return folder, materialize(rows.mapInArrow(write, "name string, n_docs bigint, n_tokens bigint"), "token-manifest")


def read_token_files(folder: str, files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    ``files`` names the files with the ids they hold (the result of the writer).
    """
    spark = files.sparkSession
    n = files.count()
    shape = "name string, doc_id bigint, place bigint, n_tokens bigint, ids_crc32 bigint"
    if not n:
        return spark.createDataFrame([], shape).selectExpr("doc_id", "place AS start", "n_tokens", "ids_crc32")
    before = W.orderBy("name").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    starts = files.select(F.col("name").alias("of"), F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first"))
    found = files.select("name").repartitionByRange(min(n, FILES), "name")  # a file or a few a task

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for name in (x for batch in batches for x in batch.column(0).to_pylist()):
            with store.open_input_file(f"{root}/{name}") as source:
                held = TokenFile(source)
                for a, b in held.runs():
                    cuts = held.starts[a : b + 1]
                    if b - a == 1:
                        sums = [held.checksum(a)]
                    else:
                        ids = held.tokens(int(cuts[0]), int(cuts[-1])).astype("<u4")
                        sums = [zlib.crc32(ids[x:y]) for x, y in itertools.pairwise((cuts - cuts[0]).tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name] * (b - a), pa.string()),
                            pa.array(held.keys[a:b], pa.int64()),
                            pa.array(cuts[:-1], pa.int64()),
                            pa.array(np.diff(cuts), pa.int64()),
                            pa.array(sums, pa.int64()),
                        ],
                        names=["name", "doc_id", "place", "n_tokens", "ids_crc32"],
                    )

    rows = found.mapInArrow(read, shape)
    return rows.join(small_side(starts, n), F.col("name") == F.col("of")).select(
        "doc_id", (F.col("first") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_rows(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the files and read them back."""
    return read_token_files(*write_token_files(docs, tokenizer))
