import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or v != v:
        return None
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["item_id", "rank", "chunk_id", "score", "text"] and rows.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, db, name):
    got = entry.queries()[name](spark, SF)
    want = db.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    left = sorted((tuple(cell(r[c]) for c in columns) for r in got.collect()), key=repr)
    order = [want.columns.index(c) for c in columns]
    right = sorted((tuple(cell(r[i]) for i in order) for r in want.fetchall()), key=repr)
    assert left == right
