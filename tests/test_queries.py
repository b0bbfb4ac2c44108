import os

import pytest

from flowloom.plans import catalog
from tests.oracle import differs

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_agrees_with_sql(spark, name):
    assert name in catalog.ORACLES
    assert differs(spark, catalog.QUERIES[name], catalog.ORACLES[name], SF) == ""


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
