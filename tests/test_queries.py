"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

from mediaflow.plans import ORACLES, QUERIES
from tests.oracle import connect, differences

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

@pytest.fixture(scope="module")
def tables():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, tables, name):
    assert differences(QUERIES[name](spark, FOLDER), tables, ORACLES[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_is_the_tag_job(spark):
    import __spark_entry__ as contract

    counts = {row["contaminated"]: row["n_rows"] for row in contract.entry(spark).collect()}
    assert set(counts) == {0, 1}
    assert set(contract.oracle_sql()) <= set(contract.queries())
