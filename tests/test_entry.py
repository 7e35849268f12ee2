import __spark_entry__ as entry


def test_queries_and_sql_match():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert sql.keys() <= queries.keys() and len(queries) > 50
    assert all(callable(q) for q in queries.values())
