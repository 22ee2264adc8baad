"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

from ledgerloom.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    tidy = lambda v: repr(round(v, 9)) if isinstance(v, float) else str(v)
    return sorted(tuple(tidy(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    want = canon(cursor.fetchall(), columns)
    frame = QUERIES[name](spark, SF)
    assert sorted(frame.columns) == sorted(columns)
    assert canon([tuple(r) for r in frame.collect()], frame.columns) == want
