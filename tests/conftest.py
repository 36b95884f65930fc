import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from litspark.session import checkpoint_dir, drop_staged, get_spark
    s = get_spark("local[4]", "litspark-tests", shuffle_partitions=4)
    checkpoint_dir(s)  # unset in tests → a fresh local folder
    yield s
    drop_staged(s)


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="litspark-test-")
