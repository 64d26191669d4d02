"""Every registered query on the small tables; its SQL where there is some."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from gleaner.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("GLEANER_TEST_SF", "/root/testdata/sf0.001")


def test_all_are_registered():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert QUERIES.keys() | {"pipeline"} <= contract.queries().keys()
    assert ORACLES.keys() <= contract.oracle_sql().keys() & QUERIES.keys()


def ordered(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for file in os.listdir(SF_DIR):
        duck.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{file}'")
    found, want = QUERIES[name](spark, SF_DIR), duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(found.columns) == sorted(columns)
    assert ordered(found.columns, map(tuple, found.collect())) == ordered(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_query_covers_its_table(spark, name):
    out = QUERIES[name](spark, SF_DIR)
    if name == "op12_variants":  # a row for each word, checked in its own tests
        assert out.count() == out.select("word").distinct().count() > 0
        return
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert out.select("doc_id").distinct().count() == docs.count()
