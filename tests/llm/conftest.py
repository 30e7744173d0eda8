import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
ROOT = os.path.dirname(os.path.dirname(HERE))
sys.path[:0] = [p for p in (ROOT, os.path.dirname(HERE), HERE) if p not in sys.path]


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema)

    return make
