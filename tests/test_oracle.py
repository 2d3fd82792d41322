"""Every query with SQL agrees with it on the smallest tables, and all queries run."""

import os

import pytest
from compare import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_agrees_with_sql(spark, con, name):
    assert compare(spark, name, entry.queries()[name], entry.oracle_sql()[name], SF, con) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_text_subpackage():
    import subprocess
    import sys

    code = (
        "import sys; sys.modules['codequarry.llm'] = None\n"
        "import __spark_entry__ as e; assert 'p1_found' in e.queries() and 'p3_found' not in e.queries()"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
