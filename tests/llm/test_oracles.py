import duckdb
import pytest

from attestry.llm import registry

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.execute(f"select {', '.join(columns)} from ({registry.ORACLES[name]})").fetchall()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got.select(*columns).collect())) == sorted(map(key, want))
