import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from logweave.session import get_session

    extra = {}
    from pyspark.sql import SparkSession

    if SparkSession.getActiveSession() is None:
        # tests only: a private shared folder when the cluster names none
        extra["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="logweave-test-ckpt-")
    s = get_session(app_name="logweave-tests", master="local[4]", shuffle_partitions=8, extra_conf=extra)
    s.sparkContext.setLogLevel("ERROR")
    yield s
