"""Every registered query of the core against its SQL on the smallest sample."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from ledgerloom.oracle import oracle_sql
from ledgerloom.queries import REGISTRY
from tests.compare import compare, duck
from tests.conftest import SF

SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(REGISTRY) == set(SQL)
    assert set(REGISTRY) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, con, name):
    problem = compare(spark, con, name, REGISTRY[name], SQL[name], SF)
    assert problem is None, problem


def test_entry(spark):
    assert {r.status for r in entry.entry(spark).collect()} == {"APROBADO", "PENDIENTE", "RECHAZADO"}
