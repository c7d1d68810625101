from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from calibra.llm import codes

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


def expected(library, rows):
    """Rows in the order of the ids, null ids first; equal ids only once here."""
    out, start = {}, 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(ids_of(library, text), "<u4")
        out[key] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    return out


def got(df):
    return {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in df.collect()}


def test_words_are_the_tokenizers(library):
    draw, encoder = random.Random(2), codes.WordEncoder(PATH, 1)
    parts = ["a", "The", "é", "É", "ß", "Σ", "ΣΑΣ", "İ", " ", "\n", "\t", "\x0b", "\x1c", "\xa0", " ", "1", "12", "'s",
             "'S", "!", "***", "### ", "日本", "é", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "ŉ", "œ", "ﬁ", "a.b", "can't"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.choice([0, 1, 2, 8, 30]))) for _ in range(1500)]
    ids, counts = encoder.encode([t.encode() for t in texts])
    want = [ids_of(library, t) for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_memory_is_bounded_in_bytes(monkeypatch, library):
    monkeypatch.setattr(codes, "CACHE_BYTES", 4000)
    encoder, draw = codes.WordEncoder(PATH, 1), random.Random(7)
    for text in ("one two three", "four five six seven eight nine", "one two", ""):
        assert encoder.encode([text.encode()])[0].tolist() == ids_of(library, text)
    for n in range(200):
        text = "common words " + " ".join(f"rare{draw.random()}" for _ in range(5))
        assert encoder.encode([text.encode()])[0].tolist() == ids_of(library, text)
        assert len(encoder.kept.now) + len(encoder.kept.before) < 2 * (2000 // codes.ENTRY_BYTES + 60)
    assert b"common" in encoder.kept.now or b"common" in encoder.kept.before


def test_growing_levels_are_those_of_one_piece():
    draw = np.random.default_rng(3)
    counts = draw.integers(0, 900, 40)
    ids = draw.choice(np.array([1, 255, 256, 70_000, 2**25], np.uint32), counts.sum())
    whole, writer, lo = codes.pack([*range(40)], counts, ids), codes.TokenWriter(), 0
    for k, n in enumerate(counts.tolist()):
        writer.add([k], np.array([n]), ids[lo : lo + n])
        lo += n
    assert b"".join(bytes(p) for p in writer.parts()) == whole
    held = codes.TokenFile(whole)
    assert [held.token(i) for i in range(0, len(ids), 97)] == ids[::97].tolist()
    assert (held.tokens(0, len(ids)) == ids).all()


def test_long_documents_are_read_in_runs(monkeypatch):
    monkeypatch.setattr(codes, "READ_IDS", 100)
    counts = np.array([0, 30, 30, 950, 1, 0, 99, 2])
    ids = np.arange(counts.sum(), dtype=np.uint32) * 77
    held = codes.TokenFile(codes.pack([*range(8)], counts, ids))
    runs = list(held.runs())
    assert [a for a, _ in runs] + [8] == [0] + [b for _, b in runs]
    assert all(b - a == 1 or counts[a:b].sum() <= 100 for a, b in runs)
    ends = np.cumsum(counts)
    assert [held.checksum(k) for k in range(8)] == [zlib.crc32(ids[e - n : e].astype("<u4")) for e, n in zip(ends, counts, strict=True)]


def test_a_file_that_is_there_stays(tmp_path):
    class Strict:
        """A store whose rename does not overwrite."""

        def __init__(self):
            self.inner = codes.fs.LocalFileSystem()

        def move(self, a, b):
            if self.inner.get_file_info(b).type == codes.fs.FileType.File:
                raise OSError("exists")
            self.inner.move(a, b)

        def __getattr__(self, name):
            return getattr(self.inner, name)

    for name in ("h1", "h2"):
        (tmp_path / name).write_bytes(b"x")
        codes._put(Strict(), f"{tmp_path}/{name}", f"{tmp_path}/part")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["part"]
    with pytest.raises(OSError):
        codes._put(Strict(), f"{tmp_path}/none", f"{tmp_path}/other")


@pytest.mark.parametrize("top", [1, 200, 256, 70_000, 2**32 - 1])
def test_round_trip(top):
    draw = np.random.default_rng(top % 1000)
    ids = draw.integers(0, top, 3000, dtype=np.uint32, endpoint=True)
    ids[::7] = draw.integers(0, min(top, 255), len(ids[::7]), endpoint=True)
    counts = np.array([0, 1000, 1, 1999])
    held = codes.TokenFile(codes.pack([3, None, 5, -9], counts, ids))
    assert held.keys == [3, None, 5, -9] and held.size == 3000
    assert (held.tokens(0, 3000) == ids).all()
    assert [held.token(i) for i in range(0, 3000, 13)] == ids[::13].tolist()
    for a, b in ((0, 0), (5, 6), (511, 513), (700, 2999), (2999, 3000), (3000, 3000)):
        assert (held.tokens(a, b) == ids[a:b]).all()
    assert (held.document(3) == ids[1001:]).all() and len(held.document(0)) == 0
    with pytest.raises(ValueError, match="token file"):
        codes.TokenFile(b"nothing at all")


def test_documents(documents, texts, library):
    assert got(codes.token_rows(documents, PATH)) == expected(library, texts.items())


def test_many_files(spark, documents, texts, library):
    folder, files = codes.write_token_files(documents, PATH, file_bytes=40_000)
    assert files.count() > 5
    assert got(codes.read_token_files(folder, files)) == expected(library, texts.items())


def test_odd_rows(odd_docs, no_docs, library):
    plain = odd_docs.where("doc_id != 5")
    rows = [(r["doc_id"], r["text"]) for r in plain.collect()]
    assert got(codes.token_rows(plain, PATH)) == expected(library, rows)
    out = codes.token_rows(odd_docs, PATH).orderBy("start").collect()
    assert len(out) == odd_docs.count()
    assert [r["start"] for r in out] == [0, *np.cumsum([r["n_tokens"] for r in out])[:-1].tolist()]
    assert codes.token_rows(no_docs, PATH).collect() == []
