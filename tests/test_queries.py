"""Every query with SQL gives the rows of its SQL; every other query gives rows with a stable schema."""

from __future__ import annotations

import pytest

from leafmill.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, spark, sf_dir, duck, same_rows):
    same_rows(QUERIES[name](spark, sf_dir), duck.execute(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, sf_dir):
    a, b = QUERIES[name](spark, sf_dir), QUERIES[name](spark, sf_dir)
    assert a.schema == b.schema and a.count() == b.count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scope_fails_closed(spark, sf_dir):
    from leafmill.scope import scoped
    from leafmill.sources.tables import jobs

    j = jobs(spark, sf_dir)
    assert scoped(j, None, "ten_1").isEmpty() and scoped(j, "machinery", "").isEmpty()
    one = j.select("product_id", "tenant_id").first()
    assert not scoped(j, *one).isEmpty()
    assert scoped(j, one[0], "ten_none").isEmpty()
