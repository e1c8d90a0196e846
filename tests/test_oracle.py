"""Every query with SQL gives the SQL's rows, on the smallest tables; the others run."""

import math
import os

import pytest

import __spark_entry__ as entry
from loomgrid.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Queries that need more bins than the smallest tables have.
FEW_BINS = ("multires_fetch", "remove_diagonal")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])

    def value(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
        return x

    return sorted((tuple(value(r[k]) for k in order) for r in rows), key=repr), [names[k] for k in order]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLE_SQL[name])
    left, left_names = plain([tuple(r) for r in got.collect()], got.columns)
    right, right_names = plain(want.fetchall(), [d[0] for d in want.description])
    assert left_names == right_names
    assert len(left) == len(right)
    assert left or name in FEW_BINS
    assert left == right


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_others_run(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["chr", "bin1", "bin2", "obs"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
