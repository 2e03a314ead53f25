"""Every driver query against its SQL, on the smallest tables, and the contract of the entry module."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql.classic.dataframe import DataFrame

import __spark_entry__
from trowel.plans import codebase_oracle, driver, findings, oracle

QUERIES, SQL = driver.QUERIES | findings.QUERIES, oracle.SQL | codebase_oracle.SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sql, name):
    df = QUERIES[name](spark, DATA)
    cursor = sql.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted(tuple(plain(dict(zip(columns, r))[c]) for c in sorted(columns)) for r in cursor.fetchall())
    got = sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect())
    assert got == want


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["survey_drawio", "survey_frontier_lines", "survey_payload"])
def test_drawn_and_printed_rows_stay_off_the_driver(spark, monkeypatch, name):
    def held(self, *_, real=DataFrame.collect):
        rows = real(self)
        assert len(rows) < 100
        return rows

    monkeypatch.setattr(DataFrame, "collect", held)
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda self, *_: iter(held(self)))
    assert QUERIES[name](spark, DATA).count() >= 200


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")
def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_nothing_else_imports_the_training_data_subpackage():
    root = Path(__file__).resolve().parents[1] / "trowel"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "trowel.llm" not in p.read_text(), p
