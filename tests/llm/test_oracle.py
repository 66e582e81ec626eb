"""Queries of the package against their SQL twins, over whole tables."""

import duckdb
import pytest

from wattscope.llm import catalog, oracle

DIR = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels")


def plain(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_twin(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.execute(oracle.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = catalog.queries()[name](spark, DIR)
    assert sorted(got.columns) == sorted(names)
    assert plain(got.select(*names).collect()) == plain(want.fetchall())
