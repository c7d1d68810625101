"""The corpus pipeline: stages that each read what their predecessor wrote.

Quality, near duplicates, benchmark overlaps, the mix of sources, token files.
Every stage takes (spark, docs, sf_dir); all but the last return the columns of
``documents``. The result of a stage has to be written before the next stage is
called, which then drops the tables that the stage before wrote for itself.

Defined results: null and empty texts are scored like any other, are near
duplicates of nothing, overlap nothing and have no words to mix, so the mix
takes them as often as the whole part of their source's rate; a null source is
a source; of rows alike in id and text, and of equal texts, one stays, that
with the least id (null last); very long texts are read whole; an empty table
gives an empty result. The network of the first stage and the hashes of the third have
no SQL, so the run is tested against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from calibra.llm import codes, decontam, forest, mixing, quality
from calibra.llm.common import stage_tables
from calibra.llm.queries import table, tokenizer_path
from calibra.session import materialize, ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network keeps; it learns from their labels."""
    with stage_tables(spark):
        return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate class."""
    ship_package(spark)
    with stage_tables(spark):
        return forest.one_of_each(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark overlap."""
    with stage_tables(spark):
        return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    with stage_tables(spark):
        return mixing.mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 as read back from the token files."""
    ship_package(spark)
    with stage_tables(spark):
        return codes.token_rows(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_documents),
    ("near_duplicates", distinct_documents),
    ("decontamination", clean_documents),
    ("mixing", mixed_documents),
    ("token_files", token_files),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
