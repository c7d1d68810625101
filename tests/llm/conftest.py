from __future__ import annotations

import pytest

#: What every operator must take: nulls, empty, short, long and repeated texts, rows alike, a clashing column.
TEXTS = [
    None,
    "",
    " \n\t ",
    "one two",
    "word " * 3000,
    "a b c d e f g h i j k l m n o p",
    "a b c d e f g h i j k l m n o p",
    "Zeile eins ist hier\nZeile zwei ist da\nZeile drei kommt\nZeile vier geht\nZeile fünf steht",
    "日本語 のテキスト é ß \x1c \xa0 ends",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with every odd case; ids repeat and are null, own_h1 and size clash with inner names."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, len(t or ""), 7, "x") for i, t in enumerate(TEXTS)]
    rows += [(None, "text without any id at all", "en", "s1", 3, 7, "x")] * 2
    rows += [(5, TEXTS[5], "en", "s2", 31, 7, "x")] * 3  # rows alike
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, size long, own_h1 string"
    ).cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
