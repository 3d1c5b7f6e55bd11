"""Every registered query runs; those with a SQL check give the same rows as DuckDB."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    con = duckdb.connect()
    for file in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(round(r[i], 5) if isinstance(r[i], float) else r[i] for i in order) for r in rows]
    return sorted(plain, key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con, data):
    result = QUERIES[name](spark, data)
    got = canonical(result.columns, [tuple(r) for r in result.collect()])
    if name not in ORACLES:
        assert got
        return
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(result.columns)
    assert got == canonical(columns, cursor.fetchall())


def test_all_checks_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns[:1] == ["farm_id"] or "farm_id" in entry.entry(spark).columns
