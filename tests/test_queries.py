"""Each registered query against its SQL on the smallest tables, where they are at hand."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from atlasmill import queries as own

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = lambda v: "~" if v is None else repr(round(float(v), 6) + 0.0) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    return sorted("|".join(shown(r[i]) for i in order) for r in values)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(own.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = own.QUERIES[name](spark, str(DATA))
    want = duck.sql(own.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_result_lines_of_every_located_kind(spark):
    got = own.k01_all_result_lines(spark, str(DATA))
    parts = spark.read.parquet(f"{DATA}/part.parquet")
    assert got.count() == parts.where("p_partkey % 6 not in (3, 5)").count()
    assert got.where("ring = ''").count() == parts.where("p_partkey % 6 = 4").count() > 0
