import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from millstone.session import get_spark

    from millstone.session import checkpoint_dir

    s = get_spark("millstone-tests", "local[8]", 8)
    checkpoint_dir(s)  # the session's setting; a scratch folder only when it is unset
    yield s
    s.stop()
