"""One small local session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from parleylake import session

    made = session.local(cores=4, partitions=4, memory="3g", shared=f"file://{tmp_path_factory.mktemp('shared')}")
    made.sparkContext.setLogLevel("OFF")
    made.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield made
    made.stop()
