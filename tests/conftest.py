import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

DATA = os.path.join(ROOT, "tests", "data")


@pytest.fixture(scope="session")
def spark():
    from txnclean.session import local_session
    s = local_session(8, shuffle_partitions=8,
                      checkpoint_dir=tempfile.mkdtemp(prefix="txnclean-ckpt-", dir="/tmp"),
                      warehouse_dir=tempfile.mkdtemp(prefix="txnclean-wh-", dir="/tmp"))
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="txnclean-test-", dir="/tmp")
