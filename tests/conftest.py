import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from rivulet.session import build_session
    ckpt = tempfile.mkdtemp(prefix="rivulet-test-ckpt-")
    s = build_session("local[4]", 4, app_name="rivulet-tests",
                      extra={"spark.checkpoint.dir": ckpt, "spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="rivulet-test-")


def one(spark, col, *rows, schema="x string"):
    """Evaluate a Column over literal rows; returns the list of values."""
    df = spark.createDataFrame(list(rows), schema)
    return [r[0] for r in df.select(col).collect()]
