import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_names_agree():
    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known) and len(known) > 100


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["qid", "n", "ndcg"] and df.count() > 0
