import __spark_entry__ as contract


def test_flagship(spark):
    df = contract.entry(spark)
    assert df.columns[:2] == ["Contract", "Customers"] and df.count() == 3


def test_names():
    queries = contract.queries()
    assert len(queries) > 200 and set(contract.oracle_sql()) <= set(queries)
