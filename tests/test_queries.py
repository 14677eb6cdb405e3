"""Every registered library query against its DuckDB twin."""

import decimal

import duckdb
import pytest

from nestfold import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{v:.9g}")
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows(found, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in found), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, spark, duck):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = rows([r.asDict() for r in df.collect()], columns)
    if name not in queries.ORACLE:
        assert got
        return
    result = duck.execute(queries.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == rows([dict(zip(names, r, strict=True)) for r in result.fetchall()], columns)
