"""Every registered query with a SQL twin, on the smallest tables."""

import os
import re

import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = oracle_sql()
QUERIES = queries()


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


def test_every_query_is_named_plainly():
    assert set(SQL) <= set(QUERIES)
    plain = [n for n in QUERIES if n not in SQL and n != "pipeline" and not re.match(r"op\d+_", n)]
    assert len(plain) < 15  # the corpus queries without SQL are held against brute force in their own tests


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        ok, note = check.compare(df, con, SQL[name])
        assert ok, note
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry(spark).count() > 0
