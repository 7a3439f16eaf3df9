"""Diamonds that touch at a corner or along a side, against the SQL of their query."""

import duckdb

from meridia.plans import QUERIES, SQL

from .test_queries import SF


def test_touching_diamonds_are_those_of_the_sql(spark, tmp_path):
    # Each key's diamond touches that of the key 16200 further; the middles' distance in doubles is 2 for some and rounds beyond it for others.
    keys = [1, 2, 3, 27, 35, 44, 27 + 33000]
    keys += [k + 16200 for k in keys]
    table = f"{tmp_path}/supplier.parquet"
    duckdb.execute(f"COPY (SELECT s.* REPLACE (k AS s_suppkey) FROM (SELECT * FROM '{SF}/supplier.parquet' LIMIT 1) s, (SELECT CAST(unnest({keys}) AS BIGINT) AS k)) TO '{table}' (FORMAT parquet)")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW supplier AS SELECT * FROM read_parquet('{table}')")
    want = set(c.execute(f"SELECT a, b FROM ({SQL['c5_polygon_adjacency']})").fetchall())
    assert (1, 16201) in want and (27, 16227) not in want
    got = [(r.a, r.b) for r in QUERIES["c5_polygon_adjacency"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
