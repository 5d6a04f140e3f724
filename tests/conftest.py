import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from gleanwork.session import local_session

    return local_session(4, 4)


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"
