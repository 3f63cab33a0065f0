"""Every query that has SQL gives the same rows as the SQL."""

from __future__ import annotations

import importlib

import pytest

import __spark_entry__ as entry
from tests.compare import DATA, actual, expected

CORE = {k: (m.QUERIES[k], s) for n in entry._MODULES for m in [importlib.import_module(n)] for k, s in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(CORE))
def test_same_rows_as_sql(spark, name):
    query, sql = CORE[name]
    assert actual(query(spark, DATA)) == expected(sql)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
