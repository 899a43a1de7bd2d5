from __future__ import annotations

import __spark_entry__ as E


def test_registry():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) > 80


def test_entry(spark):
    assert E.entry(spark).count() > 0
