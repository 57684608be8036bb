import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

from covermill.session import build_session, ensure_checkpoint_dir, prepare  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = prepare(build_session("local[8]", "tests", 4))
    s.sparkContext.setLogLevel("OFF")
    ensure_checkpoint_dir(s)
    yield s
    s.stop()
