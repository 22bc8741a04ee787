"""Every query of the library against its reference SQL."""

from __future__ import annotations

import pytest

from readlake.plans import registry
from tests import oracle


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_reference(spark, sf, name):
    oracle.check(registry.queries()[name](spark, sf).toPandas(), registry.oracle_sql()[name], sf)


def test_every_query_has_a_reference_or_a_test():
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"quotes"}


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["doc_id", "rank", "word", "tf"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
