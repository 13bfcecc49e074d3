"""Every query that has a SQL twin returns the same rows on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import canonical, views

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_entry(spark):
    assert len(entry.entry(spark).columns) == 5 and entry.entry(spark).count() > 0


def test_all_core_queries_with_their_twins(spark):
    con, oracle, bad = views(FOLDER), entry.oracle_sql(), []
    for name, f in entry.queries().items():
        if f.__module__.startswith("thicket.llm"):
            continue
        got = f(spark, FOLDER).toPandas()
        if name in oracle:
            a, b = canonical(got), canonical(con.execute(oracle[name]).df())
            if list(a.columns) != list(b.columns) or not a.equals(b):
                bad.append(name)
    assert not bad


def test_names_are_unique_and_twins_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
