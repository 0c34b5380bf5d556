"""Every registered query of the engine against its SQL on the smallest data."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import duckdb
import pytest

from millrace import catalogue


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        if isinstance(v, float):
            return f"{v:.9g}"
        if isinstance(v, dt.datetime):
            return v.replace(tzinfo=None).isoformat()
        return repr(v)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_matches_sql(spark, duck, sf_dir, name):
    found = catalogue.queries()[name](spark, sf_dir)
    result = duck.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(found.columns) == sorted(columns)
    assert normal(found.collect(), found.columns) == normal(result.fetchall(), columns)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
