import datetime
import math

import duckdb
import pytest

from attestry.plans import catalogue

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else x.isoformat() if isinstance(x, datetime.datetime) else str(x)


@pytest.mark.parametrize("name", sorted(catalogue.oracles()))
def test_query_equals_its_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({catalogue.oracles()[name]})").fetchall()
    rows = lambda rs: sorted(tuple(plain(x) for x in r) for r in rs)
    assert rows(got.select(*columns).collect()) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracles())))
def test_other_queries_run(spark, name):
    assert catalogue.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 40
