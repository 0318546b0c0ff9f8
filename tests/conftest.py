import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pivotscore.session import get_session
    ckpt = tempfile.mkdtemp(prefix="pivotscore-test-")
    s = get_session("local[4]", 4, extra={"spark.checkpoint.dir": ckpt})
    yield s


SF = "/root/testdata/sf0.001"
