import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from platewise.session import build_session

    s = build_session("local[4]", app="platewise-tests", shuffle_partitions=4)
    # tests set their own checkpoint folder (a cluster provides a shared one)
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="platewise-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="platewise-test-")
