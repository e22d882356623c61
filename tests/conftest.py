import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

from matchlode.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, 2, "4g")


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
