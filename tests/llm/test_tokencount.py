from __future__ import annotations

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from calibra.llm import tokencount

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
PARTS = ["a", "B", " ", "  ", "\n", "\t", "1", "9", "'s", "'t", "é", "-", "!!", "日", "x'll", " \n ", "\x1c", "ɏ", "²", "\xa0"]


@pytest.fixture(scope="module")
def counter():
    return tokencount.PieceCounter(RANKS, PATTERN)


def full(counter, text):
    return len(counter.known.library.encode_ordinary(text or ""))


def test_edits_follow_a_full_count(counter):
    draw = random.Random(1)
    for _ in range(600):
        text = "".join(draw.choice(PARTS) for _ in range(draw.choice([0, 1, 3, 20, 200, 900])))
        tree = tokencount.CountTree.of_text(text, counter)
        assert (tree.tokens, tree.chars) == (full(counter, text), len(text))
        for _ in range(4):
            start = draw.randint(0, len(text) + 2)
            new = "".join(draw.choice(PARTS) for _ in range(draw.choice([0, 1, 2, 8, 300])))
            text, _read = tree.edit(text, start, start + draw.choice([0, 0, 1, 5, 60, 400]), new, counter)
            tree = tokencount.CountTree.from_bytes(tree.to_bytes())
            assert (tree.tokens, tree.chars) == (full(counter, text), len(text))


def test_little_is_read_again(counter):
    text = "some words of a long document, again and again. " * 4000
    tree = tokencount.CountTree.of_text(text, counter)
    changed, read = tree.edit(text, 90_000, 90_007, "other", counter)
    assert tree.tokens == full(counter, changed) and read < 1000


def test_a_large_insertion_grows_the_tree(counter):
    tree = tokencount.CountTree.of_text("tiny text", counter)
    changed, _ = tree.edit("tiny text", 4, 4, " many words" * 3000, counter)
    assert tree.tokens == full(counter, changed) and len(tree.levels[0]) > 50


def test_documents(documents, texts, counter):
    trees = tokencount.with_trees(documents.select("doc_id", "text"), RANKS, PATTERN)
    edits = trees.withColumn("edits", tokencount.revision())
    rows = tokencount.recount(edits, RANKS, PATTERN, edits="edits").collect()
    out = {r["doc_id"]: tuple(r) for r in tokencount.count_rows(documents, RANKS, PATTERN).collect()}
    for r in rows:
        text = texts[r["doc_id"]]
        assert r["tokens_before"] == full(counter, text)
        for e in r["edits"]:
            start = min(e["start"], len(text))
            text = text[:start] + e["new"] + text[min(max(start, e["stop"]), len(text)) :]
        assert r["text"] == text and r["tokens_after"] == full(counter, text)
        assert out[r["doc_id"]] == (r["doc_id"], r["tokens_before"], r["tokens_after"], r["chars_read"])


def test_odd_rows(odd_docs, no_docs, counter):
    rows = tokencount.count_rows(odd_docs, RANKS, PATTERN).collect()
    assert len(rows) == odd_docs.count()
    assert {r["tokens_before"] for r in rows if r["doc_id"] in (0, 1)} == {0}
    assert tokencount.count_rows(no_docs, RANKS, PATTERN).collect() == []
    named = odd_docs.withColumnRenamed("size", "chars_read")
    edits = F.lit(None).cast(f"array<{tokencount.EDIT}>")
    out = tokencount.recount(tokencount.with_trees(named, RANKS, PATTERN).withColumn("e", edits), RANKS, PATTERN, edits="e")
    assert out.columns[-3:] == ["tokens_before", "tokens_after", "own_chars_read"]
    assert all(r["tokens_before"] == r["tokens_after"] == full(counter, r["text"]) for r in out.collect())
