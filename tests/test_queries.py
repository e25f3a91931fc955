"""Every registered query against its SQL; those without SQL give rows of a stable schema."""

import pytest

from corvane import queries_more  # noqa: F401
from corvane.queries import ORACLE, QUERIES

from .oracle import SF, check


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    check(spark, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE.keys()))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).limit(1).count() <= 1


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert e.oracle_sql().keys() <= e.queries().keys()
