"""Every registered query with SQL agrees with DuckDB; every other one runs."""

import math

import duckdb
import pytest
from conftest import SF

from reelquery.plans import catalogue


def plain(x):
    if hasattr(x, "asDict"):
        x = list(x)
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    return x


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in ("documents", "labels", "events", "orders", "lineitem", "embeddings", "customer"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr(plain(list(r))) for r in df.select(*columns).collect())
    assert rows
    if name in catalogue.ORACLES:
        quoted = ', '.join(f'"{c}"' for c in columns)
        want = duck.execute(f"SELECT {quoted} FROM ({catalogue.ORACLES[name]})").fetchall()
        assert rows == sorted(repr(plain(list(r))) for r in want)
