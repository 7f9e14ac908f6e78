import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from foldwise.session import checkpoint_dir, local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4, app="foldwise-tests", extra={"spark.driver.memory": "4g"})
    checkpoint_dir(s, tempfile.mkdtemp(prefix="fw-test-ckpt-", dir="/tmp"))
    yield s
    s.stop()
