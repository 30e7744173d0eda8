"""Every registered query against its SQL, and rows from those without SQL."""

import glob
import os
import subprocess
import sys

import pyspark
import pytest
from oracle import compare, connect

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
SLOW = {"tfidf_svm", "compare_classifiers", "mlp_batch_predict", "select_by_importance"}


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, small, con, name):
    assert compare(spark, small, QUERIES[name], SQL[name], con) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_gives_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_sql_only_for_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry_imports_without_session_or_files():
    """As a driver imports it: PySpark from its zip, no session, no JVM."""
    lib = os.path.join(os.path.dirname(pyspark.__file__), "python", "lib")
    paths = glob.glob(f"{lib}/*.zip")
    if not paths:
        pytest.skip("this PySpark has no zip")
    code = (
        "import __spark_entry__ as e, pyspark; from pyspark import SparkContext;"
        "assert '.zip' in pyspark.__file__, pyspark.__file__;"
        "assert e.queries() and set(e.oracle_sql()) <= set(e.queries());"
        "assert SparkContext._active_spark_context is None"
    )
    env = os.environ | {"PYTHONPATH": os.pathsep.join(paths)}
    root = os.path.dirname(os.path.abspath(entry.__file__))
    subprocess.run([sys.executable, "-c", code], cwd=root, env=env, check=True, timeout=120)
