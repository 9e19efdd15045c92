import __spark_entry__ as entry


def test_queries_and_sql_agree_on_names():
    known, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(known) and len(known) > 40 and all(callable(q) for q in known.values())
