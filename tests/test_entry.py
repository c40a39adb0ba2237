from __future__ import annotations

import pytest

import __spark_entry__ as entry
from check import compare
from glyphloom.checks.oracles import ORACLES
from glyphloom.checks.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "rank", "id", "score"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, FOLDER, name).startswith("ok")
