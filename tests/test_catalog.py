"""Every registered query against its SQL on DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from marketloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    try:
        return float(f"{float(v):.7g}") + 0.0
    except (TypeError, ValueError):
        return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, duck, small, name):
    frame = catalog.QUERIES[name](spark, small)
    want = duck.execute(catalog.SQL[name])
    assert table(frame.columns, frame.collect()) == table([c[0] for c in want.description], want.fetchall())
