"""Every registered query runs; those with SQL give the same rows as DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry_module

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES = entry_module.queries()
ORACLES = entry_module.oracle_sql()


def cell(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(int(value)) if value == int(value) else repr(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["class", "count", "percentage", "tier", "weight"]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_oracle(spark, sf_dir, oracle, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    cursor = oracle.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    want = sorted(tuple(cell(r[i]) for i in order) for r in cursor.fetchall())
    assert [names[i] for i in order] == columns
    assert got == want


FAST_ROWS_ONLY = ("assemble", "pca_variance", "svd_variance", "smote_rows", "registry_document", "history_append")


@pytest.mark.parametrize("name", FAST_ROWS_ONLY)
def test_rows_only(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
