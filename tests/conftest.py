import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sendscope.session import get_session
    ckpt = str(tmp_path_factory.mktemp("checkpoints"))
    s = get_session("local[*]", 8, app_name="sendscope-tests",
                    extra={"spark.checkpoint.dir": ckpt})
    yield s
    s.stop()


SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
