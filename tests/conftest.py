import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from scorewright.session import get_session
    s = get_session("local[4]", 8, app_name="scorewright-tests",
                    extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="sw-test-ckpt-")})
    yield s
    s.stop()
