import os

import pytest

import __spark_entry__ as entry
from bagmeter.plans import registry

DATA = "/root/testdata/sf0.001"


def test_names_are_unique_and_sql_belongs_to_queries():
    core = registry.queries()
    assert set(registry.oracle_sql()) <= set(core)
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(core) <= set(entry.queries())


@pytest.mark.skipif(not os.path.exists(DATA), reason="no tables here")
def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(0 <= r["mae_mean"] <= 1 and 0 <= r["zce_mean"] <= 1 for r in rows)
