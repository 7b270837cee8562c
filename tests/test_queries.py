"""Every registered core query against its SQL, over the smallest tables."""

import os

import duckdb
import pytest

from olai.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    rows = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    found = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall()), key=repr)
    assert sorted(names) == sorted(df.columns)
    assert rows == want


def test_entry_point_has_all_queries():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
