"""The registered queries, their oracles, and the pipeline against plain versions of its stages."""

from __future__ import annotations

import re
import subprocess
import sys

import duckdb
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from calibra.llm import mixing, quality
from calibra.llm.queries import ORACLES, QUERIES
from tests.llm.brute import classes, links, overlaps, shingles


def test_every_operator_is_registered_once():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(ORACLES) <= set(QUERIES)


def test_oracles(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, sf_dir)
        cursor = con.execute(sql)
        order = [[d[0] for d in cursor.description].index(c) for c in df.columns]
        assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in order) for r in cursor.fetchall()), name


def test_pipeline_stages(spark, sf_dir, documents, texts):
    docs = documents
    bench = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    net = quality.train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    keys = list(texts)
    scores = net.scores([texts[k].encode() for k in keys], net.tables())
    held = {k: texts[k] for k, s in zip(keys, scores, strict=True) if s >= 0.3}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name == "near_duplicates":
            of = classes(held, links(held))
            held = {k: t for k, t in held.items() if of[k] == k or not shingles(t)}
        elif name == "decontamination":
            held = {k: t for k, t in held.items() if k not in {d for d, _ in overlaps(held, bench)}}
        elif name == "mixing":
            plan = {r["key"]: r["copies"] for r in mixing.mix_sources(docs).collect()}
            want = sorted(k for k in held for _ in range(plan[k]))
        if name == "token_files":
            library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            sizes = {k: len(library.encode(held[k], add_special_tokens=False).ids) + 1 for k in set(want)}
            rows = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in out.collect())
            assert [r[1] for r in rows] == want and all(n == sizes[k] for _, k, n in rows)
            assert all(a[0] + a[2] == b[0] for a, b in zip(rows, rows[1:], strict=False))
        else:
            assert out.columns == documents.columns
            docs = spark.createDataFrame(out.collect(), documents.schema)
            got = sorted(r["doc_id"] for r in docs.collect())
            assert got == (want if name == "mixing" else sorted(held)), name


def test_pipeline_takes_odd_and_empty_tables(spark, odd_docs, tmp_path):
    for n, docs in enumerate((odd_docs.select("doc_id", "text", "lang", "source", "n_chars"), odd_docs.limit(0).select("doc_id", "text", "lang", "source", "n_chars"))):
        folder = f"{tmp_path}/{n}"
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "no such words anywhere in these few texts")], "item_id long, text string").write.parquet(
            f"{folder}/benchmark.parquet"
        )
        out = corpus_pipeline.run(spark, folder)
        assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        assert out.agg(F.count(F.lit(1))).first()[0] >= (1 if n == 0 else 0)


def test_workers_get_the_package():
    """A session started elsewhere runs Python tasks without the package on the workers' path."""
    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from calibra.session import build_session\n"
        "spark = build_session('local[1]', 'shipped')\n"
        "from calibra.llm.queries import QUERIES\n"
        "print('rows', QUERIES['op2_pivot_search'](spark, sys.argv[2]).count())\n"
    )
    root = __spark_entry__.__file__.rpartition("/")[0]
    run = subprocess.run(
        [sys.executable, "-c", code, root, "/root/testdata/sf0.001"], cwd="/tmp", capture_output=True, text=True, timeout=240, check=False
    )
    assert "rows 50" in run.stdout, run.stderr[-2000:]
