import __spark_entry__ as E
from kmergrid.plans import catalog


def test_registry_is_consistent():
    queries, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(queries)
    assert set(catalog.QUERIES) <= set(sql)


def test_entry_runs(spark):
    out = E.entry(spark)
    assert out.columns == ["a", "b", "shared", "sketch_size", "jaccard", "distance"]
    assert out.count() == 190
