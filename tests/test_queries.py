"""Every registered query against its check SQL, and what the registry promises."""

import re

import pytest

import __spark_entry__ as entry_points
import check

#: Queries without check SQL are the training-data operators, which have tests of their own.
NAMES = [n for n in entry_points.queries() if n in entry_points.oracle_sql()]


@pytest.fixture(scope="module")
def engine(folder):
    return check.check_engine(folder)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, engine, folder, name):
    problem, _ = check.compare(name, spark, engine, folder)
    if problem == "no rows":  # a few selective queries need more than the smallest tables
        larger = "/root/testdata/sf0.01"
        problem, _ = check.compare(name, spark, check.check_engine(larger), larger)
    assert problem is None


def test_entry(spark):
    out = entry_points.entry(spark)
    assert out.count() > 0 and len(out.columns) == 24


def test_no_orphan_check_sql():
    assert set(entry_points.oracle_sql()) <= set(NAMES)
    assert all(n == "pipeline" or re.match(r"op\d+_", n) for n in entry_points.queries() if n not in NAMES)
