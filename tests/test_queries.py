"""Every registered query of the lake against its SQL, at the smallest size."""

import duckdb
import pytest

from ledgerlake.plans import fixtures, registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in fixtures.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, DIR)
    cols = sorted(got.columns)
    want = con.execute(registry.ORACLES[name])
    at = [[d[0] for d in want.description].index(c) for c in cols]
    rows = sorted(repr(tuple(r[k] for k in at)) for r in want.fetchall())
    assert sorted(repr(tuple(r)) for r in got.select(*cols).collect()) == rows


def test_commit_reload_of_over_1000_namespaces(spark, tmp_path):
    n = 1003
    spark.createDataFrame([(k, f"R{k}") for k in range(n)], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    # nations' ids must not meet those of the regions
    spark.createDataFrame([(n + 1, 0, "N")], "n_nationkey int, n_regionkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    got = registry.QUERIES["commit_reload"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted([(k + 1, 0, f"R{k}", 2 if k == 0 else 1) for k in range(n)] + [(n + 101, 1, "N", 1)])
