"""Every registered query of the news engine: against its SQL, or rows with a stable schema."""

from __future__ import annotations

import pytest
from pressloom import catalog

from tests.oracle import assert_same

ORACLES = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, name):
    assert_same(catalog.queries()[name](spark, sf), sf, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_entry_registers_the_engine(spark):
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
