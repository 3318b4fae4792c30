import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_keys():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and all(callable(f) for f in q.values())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_core_queries_match_sql(spark):
    import verify

    from corpusloom.plans import all_core

    assert entry.entry(spark).count() > 0
    assert verify.run(SMALL, list(all_core().queries)) == []
