"""Every registered relational query against DuckDB, as the driver compares them."""

import os

import pytest
from oracle import compare

from lumaframe.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    compare(catalogue.queries()[name](spark, SF), catalogue.oracle_sql()[name], SF)


def test_entry_module(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
