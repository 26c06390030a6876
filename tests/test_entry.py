"""Driver contract smoke test."""


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:2] == ["response_id", "prompt_id"]
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    from respscore.plans.registry import QUERIES
    assert set(QUERIES) <= set(q)
    # numbered queries come from the optional subpackage alone, never from the library's own registry
    assert not any(k.startswith("op") and k[2:3].isdigit() for k in QUERIES)
