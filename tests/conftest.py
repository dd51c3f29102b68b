import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from litspark.session import build_session
    s = build_session("local[4]", shuffle_partitions=4, app_name="litspark-tests")
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_run(tmp_path):
    return str(tmp_path)
