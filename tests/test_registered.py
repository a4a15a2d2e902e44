"""Every registered routing query against its SQL."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from pathloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in sorted(Path(SF).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, db, name):
    df = registry.queries()[name](spark, SF)
    got = db.execute(registry.oracle_sql()[name])
    want = got.fetchall()
    assert sorted(df.columns) == sorted(d[0] for d in got.description)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(want, [d[0] for d in got.description])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
