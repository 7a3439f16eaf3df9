"""Every registered query of the map layers against its SQL on the small tables."""

import math
from pathlib import Path

import duckdb
import pytest

from meridia.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, bool):
        return int(x)
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.8g}")
    if isinstance(x, list | tuple):
        return tuple(map(plain, x))
    if isinstance(x, int):
        return float(x)
    return x if x is None else str(x)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in SQL:
        cursor = duck.execute(SQL[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
