"""Every registered query against its SQL; the driver's session need not be ours."""

import pytest

import __spark_entry__ as entry
from ledgerlens.plans import QUERIES
from tests.compare import check, duck


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    ok, note = check(spark, con, sf_dir, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).columns == ["document_id", "rule", "severity", "affected_fields"]


def test_every_query_has_sql():
    assert [n for n, q in QUERIES.items() if q.sql is None] == []
