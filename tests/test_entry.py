import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_names_agree():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 60


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
