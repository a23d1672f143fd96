"""Every query with an oracle gives what DuckDB gives on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from rivulet.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def show(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return "null" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = [r.asDict() for r in df.collect()]
    relation = db.sql(ORACLE[name])
    columns, rows = list(relation.columns), relation.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(show(r[c]) for c in columns) for r in got) == sorted(tuple(map(show, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_library_does_not_import_the_llm_subpackage():
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(f"{here}/rivulet"):
        if "/llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    assert "rivulet.llm" not in open(f"{folder}/{f}").read()
