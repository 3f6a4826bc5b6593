import os

import pytest
from check_queries import compare, connect

SF = "/root/testdata/sf0.001"
CHECKED = (
    "cluster_merge",
    "viewer_merge",
    "suppressed_boxes",
    "rolling_rate",
    "found_entries",
    "unique_file_names",
    "run_states",
    "equalised_pixels",
)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    from __spark_entry__ import oracle_sql, queries

    note, ok = compare(spark, connect(SF), SF, name, queries()[name], oracle_sql()[name])
    assert ok, note


def test_every_sql_has_a_query():
    from __spark_entry__ import oracle_sql, queries

    assert set(oracle_sql()) <= set(queries())
