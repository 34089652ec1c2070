"""One small session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessella.session import importable, session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ.setdefault("TESSELLA_DRIVER_MEMORY", "4g")
    s = session("tests", "local[4]", 4)
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield importable(s)
    s.stop()


@pytest.fixture(scope="session")
def folder():
    return os.environ.get("TESSELLA_TESTDATA", "/root/testdata/sf0.001")
