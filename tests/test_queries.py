import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def told(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    return bytes(value).hex() if isinstance(value, (bytes, bytearray)) else str(value)


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    frame = entry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(tuple(told(r[c]) for c in columns) for r in frame.collect())
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(told(r[names.index(c)]) for c in columns) for r in result.fetchall())


def test_entry_finds_the_planted_tokens(spark):
    assert [(r.rule_id, r.n, r.bytes) for r in entry.entry(spark).collect()] == [("github_pat_classic", 29, 29 * 40)]
