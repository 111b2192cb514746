import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CHEAP = ("src_products", "clean_title", "brand_impute", "vocabulary", "lsh_candidates", "hybrid_dist", "blocking_metrics", "bootstrap_split")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHEAP)
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{SF}/part.parquet'")
    made = entry.queries()[name](spark, SF)
    got = sorted(map(str, (tuple(r[c] for c in sorted(made.columns)) for r in made.collect())))
    sql = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in sql.description]
    order = [names.index(c) for c in sorted(names)]
    assert sorted(names) == sorted(made.columns)
    assert got == sorted(str(tuple(r[i] for i in order)) for r in sql.fetchall())
