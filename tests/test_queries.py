"""Every registered query of the library's own operators against its SQL, and the entry point."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tallyframe.plans import queries
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    compare(queries.QUERIES[name](spark, sf_dir), con, queries.ORACLE_SQL[name])


def test_queries_without_sql_are_samples():
    assert set(queries.QUERIES) - set(queries.ORACLE_SQL) == {"sample_random", "sample_stratified_rest"}


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_own_queries_without_what_the_others_need():
    code = "import sys; sys.modules['tokenizers'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(entry.__file__).parent, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == [str(len(queries.QUERIES)), str(len(queries.ORACLE_SQL))], done.stderr
