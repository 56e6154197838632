import glob
import os

import pytest

from citeweave.llm.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_duckdb(spark, name):
    import duckdb

    duck = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        duck.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = queries()[name](spark, DATA)
    columns = sorted(got.columns)
    answer = duck.execute(oracle_sql()[name])
    order = [[c[0] for c in answer.description].index(c) for c in columns]
    assert sorted(repr([r[c] for c in columns]) for r in got.collect()) == sorted(repr([row[i] for i in order]) for row in answer.fetchall())


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))
