"""Every query of the catalogue against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest
from terrella.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
#: Queries over generated rasters and meshes take the longest and have tests of their own.
SLOW = {"t08_subdivision", "w01_row_pairs", "w02_chunks", "t03_sphere_mesh", "t09_lines", "t10_strips"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(v):
    return v if v is None or isinstance(v, (bool, str)) else round(float(v), 6) if isinstance(v, (int, float)) else str(v)[:19]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    got = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    order = [names.index(c) for c in sorted(names)]
    want = sorted((tuple(plain(r[k]) for k in order) for r in got.fetchall()), key=repr)
    assert sorted(names) == sorted(df.columns) and rows == want
