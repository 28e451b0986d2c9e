import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from brokerlens.session import build_session, ensure_checkpoint_dir
    s = build_session("local[*]", app="brokerlens-tests", shuffle_partitions=8)
    ensure_checkpoint_dir(s, local_fallback=True)
    yield s


SF001 = "/root/testdata/sf0.01"
SF0001 = "/root/testdata/sf0.001"
