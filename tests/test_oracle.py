"""Each query against its SQL counterpart on the smallest data set."""

import os

import pytest

import __spark_entry__ as entry
from trendloom.workload import queries as workload
from trendloom.workload.oracle import ORACLE
from tests.oracle_check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no sample tables")

QUERIES = {name: query for name, query in entry.queries().items() if name in workload.QUERIES}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert compare(spark, connect(SF_DIR), name, QUERIES[name], ORACLE[name], SF_DIR) is None


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
