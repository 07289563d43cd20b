"""Every registered query against its SQL, on the smallest data."""

import os
import re

import pytest

import __spark_entry__ as entry
from tests.compare import digest, duck, rows_of_spark, rows_of_sql

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_all_queries_of_the_reference_operators_have_sql():
    # Those of the subpackage llm, where it is present, have tests of their own.
    own = {n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n)}
    assert own <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    ours = digest(*rows_of_spark(entry.queries()[name](spark, SF)))
    theirs = digest(*rows_of_sql(con, entry.oracle_sql()[name]))
    assert ours[:2] == theirs[:2]
    assert ours == theirs


def test_entry_returns_a_vocabulary(spark):
    df = entry.entry(spark)
    assert df.columns == ["token", "id", "n"]
    assert df.filter("id < 5").count() == 5
