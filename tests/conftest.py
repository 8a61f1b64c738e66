import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tickflow.plans.session import build_session

    s = build_session(
        "local[*]",
        app="tickflow-tests",
        shuffle_partitions=8,
        extra={"spark.driver.memory": "4g"},
    )
    # Tests own their session: give it a private shared folder (the cluster names its own).
    if not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tickflow-test-"))
    yield s
    s.stop()


@pytest.fixture()
def values(spark):
    """Build a one-column ``value`` DataFrame from Python strings (None allowed)."""

    def make(*msgs):
        return spark.createDataFrame([(m,) for m in msgs], "value string")

    return make
