"""Every registered query against its reference SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    result = compare(spark, con, SF_DIR, name, QUERIES[name], ORACLES.get(name))
    assert result.startswith("ok") or (result.startswith("rows") and name not in ORACLES), result


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_operator_has_a_query():
    survey = {f"{k}{i}" for k, n in dict(S=10, D=25, C=12, T=19, R=29, E=30, O=34, W=9, U=4).items() for i in range(1, n + 1)}
    covered = {op for ops in entry.OPERATORS.values() for op in ops.split()}
    assert survey <= covered, sorted(survey - covered)
