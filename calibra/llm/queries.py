"""The registered queries of this package, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from calibra.llm import (
    codes,
    decontam,
    forest,
    language,
    lexical,
    linededup,
    mixing,
    negatives,
    pii,
    quality,
    sharding,
    tokencount,
    topk,
)
from calibra.session import ship_package

Builder = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), 24)


def op2_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_rows(table(spark, sf_dir, "embeddings"))


def op3_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_rows(table(spark, sf_dir, "documents"))


def op4_byte_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokenizer_path(name: str) -> str:
    """A public vocabulary file, installed on every worker."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.token_rows(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.jaccard_rows(table(spark, sf_dir, "documents"))


def op7_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_rows(table(spark, sf_dir, "documents"))


def op8_context_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_rows(table(spark, sf_dir, "documents"))


def op9_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlap_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = tokenizer_path("byte_bpe_50k.tiktoken")
    return tokencount.count_rows(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op11_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_shared_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.negative_rows(table(spark, sf_dir, "embeddings"))


def op13_byte_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_rows(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Builder] = {
    "op1_kd_shards": op1_kd_shards,
    "op2_pivot_search": op2_pivot_search,
    "op3_line_chunks": op3_line_chunks,
    "op4_byte_quality": op4_byte_quality,
    "op5_token_codes": op5_token_codes,
    "op6_forest_join": op6_forest_join,
    "op7_pivotal_mix": op7_pivotal_mix,
    "op8_context_pii": op8_context_pii,
    "op9_spaced_seeds": op9_spaced_seeds,
    "op10_edit_counts": op10_edit_counts,
    "op11_impact_search": op11_impact_search,
    "op12_shared_negatives": op12_shared_negatives,
    "op13_byte_language": op13_byte_language,
}

ORACLES: dict[str, str] = {
    "op2_pivot_search": """
        WITH v AS (
            SELECT vec_id, [floor(1024 * x::DOUBLE) for x in embedding] AS v FROM embeddings
            WHERE embedding IS NOT NULL
              AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, x.vec_id, list_dot_product(q.v, x.v)::BIGINT AS score
            FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 100 = 0
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
        )
        SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op6_forest_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT doc_id, unnest(list_distinct(CASE
                WHEN len(w) = 0 THEN []
                WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END)) AS g
            FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
            GROUP BY ALL
        ), l AS (
            SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
            WHERE 10 * same >= 8 * (na.n + nb.n - same)
        ), r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT d.doc_id, least(d.doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = d.doc_id), d.doc_id)) AS class_id,
            (SELECT count(*) FROM l WHERE l.a = d.doc_id) AS n_links
        FROM documents d
    """,
    "op9_spaced_seeds": r"""
        WITH d AS (
            SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') IF x <> ''] AS w
            FROM documents
        ), b AS (
            SELECT item_id, [x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') IF x <> ''] AS w
            FROM benchmark
        ), dw AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM d),
        bw AS (SELECT item_id, len(w) AS n, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM b WHERE len(w) >= 5),
        a AS (
            SELECT doc_id, item_id, n, dw.p - bw.p AS place, list(bw.p) AS same FROM dw JOIN bw ON dw.w = bw.w
            GROUP BY ALL HAVING count(*) >= 10 OR (n < 13 AND 5 * count(*) >= 4 * n)
        ), f AS (
            SELECT * FROM a
            WHERE n < 13 OR len([s FOR s IN range(1, n - 11) IF len([j FOR j IN same IF j >= s AND j < s + 13]) >= 10]) > 0
        )
        SELECT doc_id, item_id, max(n)::INT AS n_words, max(len(same))::INT AS n_same FROM f GROUP BY doc_id, item_id
    """,
    "op11_impact_search": r"""
        WITH t AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
        ), i AS (
            SELECT row_number() OVER () AS i, item_id, regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), q AS (SELECT i, item_id, w, count(*) AS times FROM (SELECT i, item_id, unnest(w) AS w FROM i) GROUP BY ALL),
        d AS (SELECT r, doc_id, len(w) AS n FROM t WHERE len(w) > 0),
        a AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
        p AS (SELECT r, w, count(*) AS tf FROM (SELECT r, unnest(w) AS w FROM t) GROUP BY ALL),
        f AS (SELECT w, count(*) AS df FROM p GROUP BY w),
        s AS (
            SELECT q.i, q.item_id, d.doc_id, d.r, sum(q.times * floor(1000 * ln((2 * a.docs + 2) / (2 * f.df + 1)))::BIGINT
                * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 75 + (75 * d.n * a.docs) // a.terms))))::BIGINT AS score
            FROM q JOIN p USING (w) JOIN f USING (w) JOIN d USING (r) CROSS JOIN a
            GROUP BY ALL
        ), o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, r) AS rank FROM s WHERE score > 0)
        SELECT item_id, rank::INT AS rank, doc_id, score FROM o WHERE rank <= 10
    """,
    "op12_shared_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND label IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT q.vec_id AS anchor_id, x.vec_id, q.label = x.label AS same, list_dot_product(q.v, x.v)::BIGINT AS score
            FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 100 = 0
        ), p AS (
            SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same
        ), n AS (
            SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
            FROM p JOIN s USING (anchor_id)
            WHERE p.place <= 5 AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
        )
        SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
    """,
}
