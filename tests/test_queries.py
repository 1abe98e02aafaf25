"""Every query of the core: equal to its SQL twin where it has one, else it runs."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from twins import DATA, connection, same  # noqa: E402

from tamarack.plans.queries import ORACLE, QUERIES  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connection()


def test_twins_have_queries():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, con, name):
    same(spark, con, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).columns
