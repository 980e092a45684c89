import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stagelog.session import configure, session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = configure(session("tests", **{
        "spark__master": "local[8]", "spark__sql__shuffle__partitions": "8", "spark__driver__memory": "8g",
        "spark__checkpoint__dir": tempfile.mkdtemp(prefix="tests-")}))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def frame(spark):
    import pandas as pd

    def make(rows, schema):
        if isinstance(rows, pd.DataFrame):
            return spark.createDataFrame(rows, schema)
        return spark.createDataFrame(rows, schema)

    return make
